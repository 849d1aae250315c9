"""Hard-negative mining by coordinate pruning.

Vectors become whole numbers, so scores are exact. Rows are put into buckets of similar length and about equal size;
anchors meet every bucket, in blocks, and each pair of an anchor block and a bucket is one group of a cogroup. In it,
the bucket keeps a sorted list of each coordinate that some anchor focuses on. An anchor's largest coordinates are its
focus: from the least score that still counts follows the range in which each of them must lie in a hit; the rows in
all of these ranges are the candidates, and only they are scored. The least score that counts is raised by the scores
of a few rows at the ends of the sorted lists. The best rows of each bucket meet in a final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .whitening import fixed_point

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows of a bucket and anchors of a block, about.
BUCKET_ROWS, ANCHOR_ROWS = 4096, 1024
#: Lengths within a bucket differ by at most this factor.
SPREAD = 1.1
#: Coordinates of an anchor that prune, and rows at the end of each of their lists that are scored first.
FOCUS, SEEDS = 4, 48
#: Share of a bucket from which its candidates are scored together with the rest instead of being copied out.
DENSE = 0.25
#: Squared lengths below this have scores that fit a long with room for percentages.
_LONGEST = float(1 << 55)
_BANDS = math.ceil(math.log(math.sqrt(_LONGEST)) / math.log(SPREAD)) + 2
_ROW = "vec_id long, row long, label long, x binary, norm2 long, anchor boolean"


def prepare(rows: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, row, label, x, norm2, anchor`` of the rows that take part: whole-number vectors of ``embedding``.
    Rows without id or label, with a null vector, a null or non-finite component, or a length whose scores don't fit
    a long take no part; of several vector lengths the most frequent counts. Equal rows count once; ``row`` tells rows
    of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            takes, size = fixed_point(batch.column(3), scale, 0)
            for d in np.unique(size[takes]).tolist():
                own, x = fixed_point(batch.column(3), scale, 0, d)
                norm = (x.astype(np.float64) ** 2).sum(axis=1)
                fits = norm < _LONGEST
                flags = own.copy()
                flags[own] = fits
                part = batch.filter(pa.array(flags))
                data = [v.tobytes() for v in x[fits].astype("<i4")]
                exact = (x[fits] ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(data, pa.binary()), pa.array(exact, pa.int64())], ["vec_id", "label", "anchor", "x", "norm2"])

    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding")
    own = own.filter("vec_id is not null and label is not null and embedding is not null").mapInArrow(run, "vec_id long, label long, anchor boolean, x binary, norm2 long")
    own = written(own.dropDuplicates(["vec_id", "label", "x"]), "vectors")
    sizes = own.groupBy(F.length("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    own = own.filter(F.length("x") == (sizes[0]["d"] if sizes else 0))
    return own.select("vec_id", F.xxhash64("label", "x").alias("row"), "label", "x", "norm2", "anchor")


def _band() -> Column:
    """Number of a row's length band, 0 for a zero vector."""
    return F.when(F.col("norm2") == 0, 0).otherwise(1 + F.floor(F.log(F.col("norm2").cast("double")) / (2 * math.log(SPREAD)))).cast("int")


class Buckets:
    """How many buckets each length band has and which numbers they bear (at most _BANDS numbers)."""

    def __init__(self, rows: DataFrame, bucket_rows: int):
        found = {r["band"]: r["count"] for r in rows.groupBy(_band().alias("band")).count().collect()}
        self.chunks = [-(-found.get(b, 0) // bucket_rows) for b in range(max(found, default=0) + 1)]
        self.first = np.concatenate([[0], np.cumsum(self.chunks)]).tolist()

    def number(self) -> Column:
        """A row's bucket: one of its band's, by a hash."""
        at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), _band() + 1)
        return at(self.first[:-1]) + F.pmod(F.xxhash64("vec_id", "row"), F.greatest(at(self.chunks), F.lit(1))).cast("int")

    def reached(self, norm2: Column, least: Column) -> Column:
        """Numbers of the buckets whose longest rows can reach the score ``least`` (null: any) with a vector of that
        squared length."""
        bands = F.array(*[F.struct(F.lit(SPREAD**b * (b > 0) * (1 + 1e-9)).cast("double").alias("top"), F.lit(self.first[b]).alias("a"), F.lit(self.first[b] + n - 1).alias("z")) for b, n in enumerate(self.chunks) if n])
        near = F.filter(bands, lambda b: least.isNull() | (F.sqrt(norm2.cast("double")) * b["top"] + 1e-6 >= least))
        return F.flatten(F.transform(near, lambda b: F.sequence(b["a"], b["z"])))


class Bucket:
    """Rows of similar length with sorted lists of their unit vectors' coordinates."""

    def __init__(self, x: np.ndarray, norm: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.x, self.ids, self.rows, self.labels = x, ids, rows, labels
        self.top = float(norm.max(initial=0))
        self.unit = x / np.where(norm > 0, norm, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def seeds(self, focus: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Rows that lie farthest on the anchor's side in its focus coordinates."""
        ends = [self.sorted_list(f)[0][-SEEDS:] if up else self.sorted_list(f)[0][:SEEDS] for f, up in zip(focus.tolist(), (signs > 0).tolist())]
        return np.unique(np.concatenate(ends))

    def candidates(self, q: np.ndarray, norm: float, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Rows whose focus coordinates all lie where a score of ``least`` allows; None for all rows."""
        if least <= 0 or norm == 0:
            return None
        t = least / (norm * self.top) - 1e-9 if self.top else np.inf
        if t > 1:
            return np.zeros(0, np.int64)
        beta, ranges = math.acos(max(-1.0, t)), []
        for f in focus.tolist():
            alpha = math.acos(min(1.0, max(-1.0, q[f] / norm)))
            low, high = math.cos(min(math.pi, alpha + beta)) - 1e-9, math.cos(max(0.0, alpha - beta)) + 1e-9
            order, values = self.sorted_list(f)
            a, z = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            ranges.append((z - a, f, a, z, low, high))
        ranges.sort()
        size, f, a, z, _, _ = ranges[0]
        if size == len(self.x):
            return None
        own = self.lists[f][0][a:z]
        for size, f, _, _, low, high in ranges[1:]:
            if size < len(self.x):
                v = self.unit[own, f]
                own = own[(v >= low) & (v <= high)]
        return own

    def scores(self, q: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and their exact scores."""
        if own is None:
            return np.arange(len(self.x)), (self.x @ q).astype(np.int64)
        if len(own) > DENSE * len(self.x):
            return own, (self.x @ q).astype(np.int64)[own]
        return own, (self.x[own] @ q).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<i4").reshape(len(data), -1)


def _read(anchors: pa.Table, probes: pa.Table):
    """Arrays of both sides: vectors as floats while every score is exact in them, else as whole numbers."""
    col = lambda t, name: t.column(name).to_numpy()
    norms = [np.sqrt(col(t, "norm2").astype(np.float64)) for t in (anchors, probes)]
    kind = np.float64 if norms[0].max() * norms[1].max() < 1 << 52 else np.int64
    q, x = (_matrix(t.column("x")).astype(kind) for t in (anchors, probes))
    return q, norms[0], Bucket(x, norms[1], col(probes, "vec_id"), col(probes, "row"), col(probes, "label"))


def _focus(q: np.ndarray) -> np.ndarray:
    k = min(FOCUS, len(q))
    return np.argsort(-np.abs(q), kind="stable")[:k]


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int | None = None) -> np.ndarray:
    """Places of the first k by falling score, id and row."""
    if k is not None and len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((rows[near], ids[near], -scores[near]))][:k]
    return np.lexsort((rows, ids, -scores))[:k]


_PAIR = [("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())]


def _positives(k: int):
    """An anchor's first k rows of its label in one bucket."""

    def run(anchors: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _PAIR]
        if anchors.num_rows and probes.num_rows:
            q, norm, whole = _read(anchors, probes)
            probe_norm = np.sqrt(probes.column("norm2").to_numpy().astype(np.float64))
            ids, rows, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            for label in np.unique(labels).tolist():
                same = np.flatnonzero(whole.labels == label)
                if not len(same):
                    continue
                own = Bucket(whole.x[same], probe_norm[same], whole.ids[same], whole.rows[same], whole.labels[same])
                for a in np.flatnonzero(labels == label).tolist():
                    focus = _focus(q[a])
                    other = lambda c: c[(own.ids[c] != ids[a]) | (own.rows[c] != rows[a])]  # noqa: B023, E731
                    seeds = other(own.seeds(focus, q[a][focus]))
                    known = own.scores(q[a], seeds)[1]
                    least = float(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else -math.inf
                    found, scores = own.scores(q[a], own.candidates(q[a], norm[a], focus, least))
                    keep = (own.ids[found] != ids[a]) | (own.rows[found] != rows[a])
                    found, scores = found[keep], scores[keep]
                    best = _first(scores, own.ids[found], own.rows[found], k)
                    for c, v in zip(out, ([ids[a]] * len(best), [rows[a]] * len(best), own.ids[found[best]], own.rows[found[best]], scores[best])):
                        c.extend(v)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(_PAIR, out)})

    return run


_TRIPLE = [("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("positive_id", pa.int64()), ("positive_row", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())]


def _negatives(k: int, low: int, high: int):
    """For an anchor and each of its positives the first k rows of another label in one bucket whose scores lie in
    the positive's range."""

    def run(anchors: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _TRIPLE]
        if anchors.num_rows and probes.num_rows:
            q, norm, own = _read(anchors, probes)
            ids, rows, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            for a, pairs in enumerate(anchors.column("positives").to_pylist()):
                # least and most score as whole numbers: low * p <= 100 * s <= high * p
                spans = [(p, -(-low * p["score"] // 100), high * p["score"] // 100) for p in pairs]
                spans = [s for s in spans if s[1] <= s[2]]
                if not spans:
                    continue
                focus = _focus(q[a])
                seeds = own.seeds(focus, q[a][focus])
                known = own.scores(q[a], seeds[own.labels[seeds] != labels[a]])[1]
                least = math.inf
                for _, floor, top in spans:
                    inside = known[(known >= floor) & (known <= top)]
                    least = min(least, float(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else floor)
                found, scores = own.scores(q[a], own.candidates(q[a], norm[a], focus, least))
                keep = (own.labels[found] != labels[a]) & (scores >= least) & (scores <= max(s[2] for s in spans))
                found, scores = found[keep], scores[keep]
                for p, floor, top in spans:
                    inside = np.flatnonzero((scores >= floor) & (scores <= top))
                    best = inside[_first(scores[inside], own.ids[found[inside]], own.rows[found[inside]], k)]
                    n = len(best)
                    for c, v in zip(out, ([ids[a]] * n, [rows[a]] * n, [p["vec_id"]] * n, [p["row"]] * n, [p["score"]] * n, own.ids[found[best]], own.rows[found[best]], scores[best])):
                        c.extend(v)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(_TRIPLE, out)})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, buckets: Buckets, least: Column, blocks: int, run, schema: str) -> DataFrame:
    """Each anchor with each bucket that can hold a hit: groups of a bucket and an anchor block."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = anchors.withColumn("block", block).withColumn("bucket", F.explode(buckets.reached(F.col("norm2"), least)))
    right = rows.withColumn("bucket", buckets.number()).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same rows
    return left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(run, schema)


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, bucket_rows: int = BUCKET_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (made by ``prepare``): for each anchor and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by smaller
    vec_id, then by ``row``. An anchor without positives, or without such rows, has no row here, nor has an empty table."""
    buckets, count = Buckets(rows, bucket_rows), rows.filter("anchor").count()
    found = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long, vec_id long, row long, score long"
    if not count:
        df = rows.sparkSession.createDataFrame([], found).withColumn("rank", F.lit(0))
    else:
        blocks = -(-count // anchor_rows)
        anchors = rows.filter("anchor").select("vec_id", "row", "label", "x", "norm2")
        probes = rows.select("vec_id", "row", "label", "x", "norm2")
        near = _meet(anchors, probes, buckets, F.lit(None).cast("double"), blocks, _positives(positives), "anchor_id long, anchor_row long, vec_id long, row long, score long")
        near = written(_ranked(near, ["anchor_id", "anchor_row"], positives).drop("rank"), "positives")
        own = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "row", "score"))).alias("positives"))
        # the weakest score that counts for any of an anchor's positives; positives below zero have an empty range
        floor = F.array_min(F.filter(F.transform("positives", lambda p: p["score"]), lambda s: s >= 0)) * (low / 100) - 1e-3
        least = anchors.join(own, ["vec_id", "row"])
        df = _ranked(_meet(least, probes, buckets, floor, blocks, _negatives(negatives, low, high), found), ["anchor_id", "anchor_row", "positive_id", "positive_row"], negatives)
    return df.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepare(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0))
