"""Text cleaning, validation and segmentation as column pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CleanRules:
    """Patterns valid in Java and RE2. Neutral defaults; a corpus brings its own."""

    banner: str = r"^(?:NOTICE|DISCLAIMER)[^\n]*\n\s*"
    address_line: str = r"\n[ \t]*[0-9]{1,3}(?:\.[0-9]{1,3}){3}[ \t]*\n"
    footer_mark: str = r"ns[0-9a-z.]*da|And [0-9]+ More"
    trailing_counts: str = r"(?:\n[ \t\n]*[0-9]{1,6}[ \t]*){1,2}$"
    inline: tuple[str, ...] = (r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"[A-Za-z0-9._]+@mail[0-9]+\.example\.com", r"token = \"[0-9a-f]{40}\"")
    names: tuple[str, ...] = field(default=("address", "mail", "secret"))


#: White space of all scripts, as a class that Java and RE2 read alike.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def word_count(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long")


def cut_footer(text: Column, rules: CleanRules) -> Column:
    """The head before the last standalone address line if a footer mark follows it, else the text."""
    parts = F.split(text, rules.address_line)
    tail = F.element_at(parts, -1)
    head = F.regexp_extract(text, rf"(?s)^(.*){rules.address_line}", 1)
    return F.when((F.size(parts) > 1) & tail.rlike(rules.footer_mark), head).otherwise(text)


def clean(df: DataFrame, rules: CleanRules = CleanRules(), col: str = "text") -> DataFrame:
    """Adds ``clean_text`` and per-rule removed characters ``cut_<rule>``, in a fixed order."""
    df = df.withColumn("_t0", F.col(col))
    plan = [
        ("banner", lambda c: F.regexp_replace(c, rules.banner, "")),
        ("footer", lambda c: cut_footer(c, rules)),
        ("counts", lambda c: F.regexp_replace(c, rules.trailing_counts.replace("$", r"\z"), "")),
        *[(n, lambda c, p=p: F.regexp_replace(c, p, "")) for n, p in zip(rules.names, rules.inline)],
        ("blank", lambda c: strip_edges(F.regexp_replace(c, r"\n{3,}", "\n\n"))),
    ]
    for k, (name, f) in enumerate(plan):
        df = df.withColumn(f"_t{k + 1}", f(F.col(f"_t{k}")))
        df = df.withColumn(f"cut_{name}", (F.length(f"_t{k}") - F.length(f"_t{k + 1}")).cast("long"))
    return df.withColumn("clean_text", F.col(f"_t{len(plan)}")).drop(*[f"_t{k}" for k in range(len(plan) + 1)])


def route(df: DataFrame, key: str, pos: str, col: str = "text") -> DataFrame:
    """``disposition`` of each row: error (no key), skipped (key 0), blank, duplicate (a later valid row of
    a key) or kept. A key counts as seen only by rows that pass the content check."""
    valid = F.col(key).isNotNull() & (F.col(key) != 0) & (word_count(F.coalesce(F.col(col), F.lit(""))) > 0)
    rank = F.row_number().over(Window.partitionBy(key, valid).orderBy(pos))
    return df.withColumn(
        "disposition",
        F.when(F.col(key).isNull(), "error").when(F.col(key) == 0, "skipped").when(~valid, "blank").when(rank > 1, "duplicate").otherwise("kept"),
    )


def detect(df: DataFrame, patterns: list[tuple[str, str]], key: str, col: str = "text", around: int = 30) -> DataFrame:
    """First hit of each pattern in each text with its context, line feeds escaped."""
    found = []
    for name, pattern in patterns:
        hit = F.regexp_extract(F.col(col), f"({pattern})", 1)
        at = F.expr(f"locate(regexp_extract({col}, r'({pattern})', 1), {col})")
        start = F.greatest(F.lit(1), at - around)
        context = F.replace(F.col(col).substr(start, at + F.length(hit) + around - start), F.lit("\n"), F.lit("\\n"))
        found.append(F.when(F.col(col).rlike(pattern), F.struct(F.lit(name).alias("rule"), at.cast("long").alias("pos"), context.alias("context"))))
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.rule", "f.pos", "f.context")


def segments(df: DataFrame, key: str, col: str = "text", budget: int = 2000, sep: str = "\n") -> DataFrame:
    """Greedy merge of paragraphs up to a budget of characters; a paragraph beyond it is cut hard.
    ``key, segment_index, segment``. Written as a fold over the paragraphs inside each row."""
    paras = F.flatten(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), sep), lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(p) - 1, F.lit(0)) / budget)), lambda i: p.substr(i.cast("int") * budget + 1, F.lit(budget)))))

    def merge(state, p):
        full = (F.length(state["now"]) > 0) & (F.length(state["now"]) + F.length(p) + len(sep) > budget)
        return F.when(full, F.struct(F.array_append(state["done"], state["now"]).alias("done"), p.alias("now"))).otherwise(
            F.struct(state["done"].alias("done"), F.when(F.length(state["now"]) > 0, F.concat(state["now"], F.lit(sep), p)).otherwise(p).alias("now"))
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    whole = F.aggregate(paras, start, merge, lambda s: F.filter(F.array_append(s["done"], s["now"]), lambda x: F.length(x) > 0))
    return df.select(key, F.posexplode(whole).alias("segment_index", "segment"))


def paragraph_segments(df: DataFrame, key: str, col: str = "text", budget: int = 2000, sep: str = "\n\n") -> DataFrame:
    """``key, segment_index, segment``: texts within the budget are one segment; others are cut at paragraphs. Paragraphs
    are joined while their characters, without separators, stay within the budget; whether the next one still fits is
    asked with its whole length, and one beyond the budget is cut hard, its full pieces before its rest. The fold keeps places
    in the text, so no text is copied until the segments are known."""
    text = F.coalesce(F.col(col), F.lit(""))
    none = F.lit(None).cast("int")
    start = F.struct(F.array().cast("array<struct<s:int,n:int>>").alias("done"), none.alias("s"), none.alias("e"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def merge(w, n):
        flush = w["s"].isNotNull() & (w["size"] + n > budget)
        cuts = F.when(n > budget, F.floor((n - 1) / budget).cast("int")).otherwise(0)
        done = F.when(flush, F.array_append(w["done"], F.struct(w["s"].alias("s"), (w["e"] - w["s"]).alias("n")))).otherwise(w["done"])
        pieces = F.transform(F.filter(F.sequence(F.lit(0), cuts), lambda i: i < cuts), lambda i: F.struct((w["at"] + i * budget).alias("s"), F.lit(budget).alias("n")))
        first = F.when(flush | w["s"].isNull(), w["at"] + cuts * budget).otherwise(w["s"])
        size = F.when(flush, 0).otherwise(w["size"]) + n - cuts * budget
        return F.struct(F.concat(done, pieces).alias("done"), first.alias("s"), (w["at"] + n).alias("e"), size.alias("size"), (w["at"] + n + len(sep)).alias("at"))

    last = lambda w: F.array_append(w["done"], F.struct(w["s"].alias("s"), (w["e"] - w["s"]).alias("n")))
    long = F.aggregate(F.transform(F.split(text, sep, -1), F.length), start, merge, last)
    whole = F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("n")))
    cut = df.select(key, text.alias("_text"), F.posexplode(F.when(F.length(text) <= budget, whole).otherwise(long)).alias("segment_index", "_p"))
    return cut.select(key, "segment_index", F.col("_text").substr(F.col("_p.s") + 1, F.col("_p.n")).alias("segment"))


def apply_all(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)
