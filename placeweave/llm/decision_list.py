"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of each text are Spark expressions. From a bounded sample of labelled documents,
sequential covering grows conjunctions of thresholds by information gain, prunes them on
rows kept aside, and takes away what they cover. The list becomes one ordered conditional
expression, so scoring is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, text_or_empty

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Bounds of the training sample and of a rule list.
SAMPLE_ROWS = 20_000
THRESHOLDS, MOST_CONDITIONS, MOST_RULES = 24, 3, 12
#: Share of labelled junk among what a rule covers, on the rows kept aside, and rows it covers there at least.
LEAST_PRECISION, LEAST_COVER = 0.9, 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_share", "dup_line_share", "repeat_share", "word_length", "capital_share", "mark_share", "digit_share", "distinct_share", "n_words"]


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are hashed; only where one recurs are they
    sorted to find the places."""

    def windows(h: Column) -> Column:
        part = lambda k: F.slice(h, k, F.size(h) - 2)
        return F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda a, b: F.xxhash64(a, b))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def places(order: Column) -> Column:
        n = F.size(order) - 1
        both = F.zip_with(F.slice(order, 1, n), F.slice(order, 2, n), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(both)))

    def count(win: Column) -> Column:
        order = F.sort_array(F.zip_with(win, F.sequence(F.lit(0), F.size(win) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), 0).otherwise(_let(order, lambda o: _let(places(o), covered)))

    n = F.size(words)
    return F.when(n < 4, 0).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count)))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics BASE (long) and the shares RATIOS (double) of its whole ``text``. A null or
    empty text has none of anything; shares over nothing are 0. Columns of these names are replaced."""
    names = [c for c in docs.columns if c not in (*BASE, *RATIOS)]
    own, all_words, all_lines = spare(names, "own", "all_words", "all_lines")
    frame = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(own, text_or_empty())
    frame = frame.withColumn(all_words, F.array_remove(F.split(own, r"[\x20\x09-\x0D]+", -1), ""))
    frame = frame.withColumn("n_repeat_words", F.coalesce(repeat_words(F.col(all_words)), F.lit(0)).cast("long"))
    lines = F.filter(F.split(own, "\n", -1), lambda x: F.length(_without(x, WHITE)) > 0)
    frame = frame.withColumn(all_lines, lines)
    size = F.length(own)
    frame = (
        frame.withColumn("n_words", F.size(all_words).cast("long"))
        .withColumn("word_chars", F.length(_without(F.col(own), WHITE)).cast("long"))
        .withColumn("n_symbols", (size - F.length(_without(F.col(own), SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long"))
    )
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    count = lambda letters: size - F.length(_without(F.col(own), letters))
    shares = {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size(all_lines), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "capital_share": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        "mark_share": count("!?") / chars,
        "digit_share": count("0123456789") / chars,
        "distinct_share": F.size(F.array_distinct(all_words)) / words,
    }
    for name, share in shares.items():
        frame = frame.withColumn(name, share)
    return frame.drop(own, all_words, all_lines)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grow(bad: list[dict], good: list[dict], cuts: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    while good and len(rule) < MOST_CONDITIONS:
        best, score = None, 1e-9
        for feature, thresholds in cuts.items():
            p_values, n_values = sorted(r[feature] for r in bad), sorted(r[feature] for r in good)
            i = j = 0
            for t in thresholds:
                while i < len(p_values) and p_values[i] <= t:
                    i += 1
                while j < len(n_values) and n_values[j] <= t:
                    j += 1
                for above, p, n in ((False, i, j), (True, len(p_values) - i, len(n_values) - j)):
                    if (g := _gain(len(bad), len(good), p, n)) > score:
                        best, score = Condition(feature, above, t), g
        if best is None:
            break
        rule.append(best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def _covers(rule: list[Condition], row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def learn(rows: list[dict]) -> list[list[Condition]]:
    """Ordered rules for junk from rows of RATIOS, ``junk`` and ``aside`` (kept for pruning). Rules that aren't
    precise on the rows kept aside end the list; without junk, or without other rows, the list is empty."""
    if not rows:
        return []
    cuts = {}
    for feature in RATIOS:
        values = sorted({r[feature] for r in rows})
        step = max(1, len(values) // THRESHOLDS)
        cuts[feature] = sorted({(values[k - 1] + values[k]) / 2 for k in range(1, len(values), step)})
    rules: list[list[Condition]] = []
    while len(rules) < MOST_RULES:
        grow = [[r for r in rows if not r["aside"] and r["junk"] == junk] for junk in (True, False)]
        prune = [[r for r in rows if r["aside"] and r["junk"] == junk] for junk in (True, False)]
        if not grow[0]:
            break
        rule = _grow(*grow, cuts)
        tried = []
        for size in range(1, len(rule) + 1):
            p, n = (sum(_covers(rule[:size], r) for r in own) for own in prune)
            tried.append(((p - n) / max(1, p + n), p, n, size))
        if not tried:
            break
        _, p, n, size = max(tried, key=lambda x: (round(x[0], 3), x[1], -x[3]))
        if p + n < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule[:size])
        rows = [r for r in rows if not _covers(rule[:size], r)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: false where a rule for junk fires, else true."""
    out = None
    for rule in rules:
        fires = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[dict]:
    """Statistics of at most SAMPLE_ROWS labelled documents, in the order of a hash of their id; those that
    fail the base rules teach nothing. Of rows that share an id one text is taken. A third is kept aside for pruning."""
    rank = F.xxhash64(F.lit(11), "doc_id")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(rank, "doc_id").limit(SAMPLE_ROWS)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")  # SAMPLE_ROWS ids at most
    known = known.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = statistics(known).select(*RATIOS, (F.col("quality") == 0).alias("junk"), (F.pmod(rank, F.lit(3)) == 0).alias("aside"), base_failed().alias("failed"))
    return [r.asDict() for r in found.collect() if not r["failed"]]


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept``. Null and empty texts fail the base rules;
    repeated rows and null ids are kept; an empty table gives no rows."""
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def op7_decision_list(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
