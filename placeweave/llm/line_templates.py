"""Line dedup by a log-template tree, in DataFrame operations only.

A line descends a tree of fixed depth: its number of tokens, then its leading tokens with
tokens that hold digits as wildcards. In a leaf, lines that differ in a minority of
positions share one template whose differing positions are wildcards; the lines that do not
fit it form the leaf's next template, until a round finds none. Other lines are a template of
their own. Templates that recur across documents are boilerplate; their lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash, salted_join, spare, text_or_empty, written

#: Documents with different texts in which a template recurs.
LEAST_DOCS = 5
#: Leading tokens that the tree looks at.
DEPTH = 3
#: Share of a line's tokens that equal the leaf's template.
ALIKE = 0.7
#: A document with more of its characters than this in recurring lines is taken for a copy of another, not for a carrier of boilerplate.
COPY_SHARE = 0.5
#: Letters that a line must have beside its wildcards; a line with fewer, as in a table of numbers, stands for itself.
FIXED_LETTERS = 6
WILD = "<*>"
#: Leaves, or lines in them (a few numbers each), that may be broadcast.
BROADCAST_LEAVES = 500_000


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\f\x0b"))


def _mask(plain: Column) -> Column:
    """A trimmed line with each run of ASCII signs that holds a digit as a wildcard; null without digits."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![\x21-\x7e])[\x21-\x2f\x3a-\x7e]*+[0-9][\x21-\x7e]*+", WILD))


def _fixed(mask: Column, plain: Column) -> Column:
    return F.when(mask.rlike(rf"(?:\p{{L}}\P{{L}}*+){{{FIXED_LETTERS}}}"), mask).otherwise(plain)


def masked(line: Column) -> Column:
    """A line without outer white space, with each run of ASCII signs that holds a digit as a wildcard; as it is
    where that leaves fewer than FIXED_LETTERS letters."""
    plain = trimmed(line)
    return _fixed(_mask(plain), plain)


def n_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(n_tokens(line), F.substring_index(line, " ", depth))


def _lines(docs: DataFrame) -> DataFrame:
    """``key`` (hash of the whole text), ``raw`` (hash of the line), ``line`` (masked, not blank), ``size`` (characters of
    the line itself). Each step has columns of its own, so that a line is masked once."""
    own = docs.select(F.xxhash64("text").alias("key"), F.explode(F.split("text", "\n", -1)).alias("line"))
    own = own.select("key", F.xxhash64("line").alias("raw"), trimmed(F.col("line")).alias("plain")).filter("plain <> ''")
    own = own.withColumn("mask", _mask(F.col("plain")))
    return own.select("key", "raw", _fixed(F.col("mask"), F.col("plain")).alias("line"), F.length("plain").alias("size"))


def _counts(rows: DataFrame, by: str) -> DataFrame:
    """Different texts per value; a pair is counted once, before and after the shuffle."""
    return rows.select(by, "key").distinct().groupBy(by).agg(F.count("*").alias("n_docs"))


def _general(docs: DataFrame, lines: DataFrame, depth: int, least: int, alike: float) -> DataFrame:
    """``h, template`` of the lines that follow their leaf's template."""
    leaves = _counts(lines, "leaf").filter(F.col("n_docs") >= least).select("leaf")
    varied = lines.select("leaf", "h").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").join(leaves, "leaf").select("leaf")
    varied = written(varied, "varied")
    lone = salted_join(lines, varied, ["leaf"], F.col("key")).groupBy("leaf", "h").agg(F.min("raw").alias("raw"))  # one line of each mask
    lone = written(lone, "lone")
    if lone.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:  # only these lines are masked again
        own = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("raw", F.xxhash64("line"))
        texts = own.join(F.broadcast(lone), "raw").groupBy("leaf", "h").agg(F.first("line").alias("line")).withColumn("line", masked(F.col("line")))
    else:
        own = _lines(docs).withColumn("leaf", leaf(F.col("line"), depth))
        if varied.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:  # else the lines are shuffled by leaf
            texts = own.join(F.broadcast(varied), "leaf")
        else:
            texts = salted_join(own, varied, ["leaf"], F.col("key"))
        texts = texts.groupBy("leaf", F.xxhash64("line").alias("h")).agg(F.first("line").alias("line"))
    texts = written(texts.withColumn("tokens", F.split("line", " ", -1)).drop("line"), "leaves")
    out, turn = None, 0
    while True:
        votes = texts.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.count("*").alias("n"))  # one vote for each different line
        best = votes.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
        fixed = best.filter("2 * top.n > all").select("leaf", "pos", F.col("top.token").alias("fixed"))
        same = texts.select("leaf", "h", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
        same = salted_join(same, fixed, ["leaf", "pos"], F.col("h"))  # a leaf may hold most lines
        same = same.filter("token = fixed").groupBy("leaf", "h", "size").agg(F.count("*").alias("equal"))
        found = same.filter(F.col("equal") >= alike * F.col("size")).select("leaf", "h", F.xxhash64(F.lit("leaf"), "leaf", F.lit(turn)).alias("template"))
        found = written(found, "general")
        out = found if out is None else out.union(found)
        more = found.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf")  # elsewhere the votes stay as they are
        rest = salted_join(texts, more, ["leaf"], F.col("h")).join(found.select("leaf", "h"), ["leaf", "h"], "left_anti")
        texts, turn = written(rest, "leaves"), turn + 1
        if not texts.limit(1).count():
            return out.select("h", "template")


def boilerplate(docs: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, alike: float = ALIKE, copy_share: float = COPY_SHARE) -> DataFrame:
    """``key, raw``: the boilerplate lines of each text, both by their hashes."""
    line = F.col("line")
    lines = _lines(docs).groupBy("key", "raw", F.xxhash64(line).alias("h"), leaf(line, depth).alias("leaf")).agg(F.sum("size").alias("size"))
    lines = written(lines, "lines")
    general = _general(docs, lines, depth, least, alike)
    lines = salted_join(lines, general, ["h"], F.col("key"), how="left").withColumn("template", F.coalesce("template", "h"))
    lines = written(lines.select("key", "raw", "template", "size"), "templates")
    recurring = _counts(lines, "template").filter(F.col("n_docs") >= least).select("template", F.lit(1).alias("recurs"))
    seen = salted_join(lines, recurring, ["template"], F.col("key"), how="left")
    share = seen.groupBy("key").agg(F.sum(F.when(F.col("recurs") == 1, F.col("size")).otherwise(0)).alias("common"), F.sum("size").alias("all"))
    carriers = share.filter(F.col("common") <= copy_share * F.col("all")).select("key")
    found = written(seen.filter("recurs = 1").select("key", "raw", "template"), "recurring")
    dropped = _counts(found.join(carriers, "key"), "template").filter(F.col("n_docs") >= least).select("template")
    return salted_join(found, dropped, ["template"], F.col("key")).select("key", "raw").distinct()


def drop_templates(docs: DataFrame, least: int = LEAST_DOCS, depth: int = DEPTH, alike: float = ALIKE, copy_share: float = COPY_SHARE) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Copies of one text count once. Documents with more than ``copy_share`` of their characters in recurring lines
    are taken for copies of each other: their lines don't make a template recur (whole copies are the
    near-duplicate stage's). A document of nothing but boilerplate keeps its lines. Blank lines stay. Null and empty
    texts, and an empty table, come back as they are; repeated rows and null ids are kept; ``text`` is the only
    column read, others may have any name; columns named ``n_lines`` or ``n_dropped`` are replaced."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key, gone, rest = spare(names, "key", "gone", "rest")
    filled = docs.select(text_or_empty().alias("text")).filter("text <> ''")
    found = boilerplate(filled, least, depth, alike, copy_share).groupBy("key").agg(F.collect_set("raw").alias(gone)).withColumnRenamed("key", key)
    out = docs.select(*names).withColumn(key, F.xxhash64(text_or_empty()))
    out = salted_join(out, found, [key], row_hash(docs.select(*names)), how="left")  # copies of one text are dealt by their other columns
    before = F.split("text", "\n", -1)
    kept = F.filter(before, lambda x: ~F.array_contains(F.col(gone), F.xxhash64(x)))
    out = out.withColumn(rest, F.when(F.col(gone).isNotNull(), F.array_join(kept, "\n")))
    out = out.withColumn(rest, F.when(F.trim(F.translate(rest, "\t\r\f\x0b\n", "     ")) != "", F.col(rest)))
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(before))
    n_rest = F.when(F.col(rest).isNull(), F.col("n_lines")).otherwise(F.size(F.split(rest, "\n", -1)))
    out = out.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", (F.col("n_lines") - n_rest).cast("long"))
    own = [F.coalesce(rest, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    return out.select(*own, "n_lines", "n_dropped")


def op10_log_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_templates(docs)
