"""Whitening of embeddings.

Vectors become fixed-point integers, so counts, sums and sums of products are exact and don't depend on the order
of tasks. Each partition hands on one partial sum for each dimension and one for each pair of dimensions. The centred
covariance, which has the size of a dimension squared, is made tridiagonal by Householder reflections; bisection on
Sturm counts gives the leading eigenvalues, inverse iteration their vectors, which are made orthogonal again within a
cluster of close eigenvalues. The components are broadcast and every row is projected on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, table

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Scaled entries up to this amount stand for numbers; a vector with a larger one takes no part.
LARGEST = 1 << 40
#: Eigenvalues closer than this share of the largest belong to one cluster.
CLOSE = 1e-3
_EXACT = 1 << 53


def fixed_point(vectors, scale: int, offset: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of a batch's vectors take part, and those as integers: floor(scale * entry) + offset. Null vectors, null
    and non-finite entries, entries beyond LARGEST and vectors of another length than ``dims`` don't."""
    if pa.types.is_fixed_size_list(vectors.type) or pa.types.is_large_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    flat = vectors.flatten()
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64) if flat.null_count == 0 else np.array([np.nan if x is None else x for x in flat.to_pylist()], np.float64)
    size = np.array([-1 if x is None else x for x in vectors.value_lengths().to_pylist()], np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(scale * entries)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) <= LARGEST))])
    stop = np.cumsum(np.maximum(size, 0))
    takes = (size > 0) & (bad[stop] == bad[stop - np.maximum(size, 0)])
    if dims is None:
        return takes, size
    takes &= size == dims
    return takes, scaled[np.repeat(takes, np.maximum(size, 0))].astype(np.int64).reshape(-1, dims) + offset


def _products(y: np.ndarray) -> np.ndarray:
    """y' y, exact: in floats as long as all partial sums stay below 2^53, else in whole numbers of any size."""
    most = int(np.abs(y).max(initial=0))
    block = _EXACT // max(1, most * most)
    if block < 1:
        own = y.astype(object)
        return own.T @ own
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), min(block, 1 << 16)):
        part = y[at : at + min(block, 1 << 16)].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _sums(rows: DataFrame, column: str, scale: int, offset: int) -> tuple[int, list[int]]:
    """Vectors that take part, and their sum in each dimension. The length of most vectors counts (the longer one,
    where two are as frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            takes, size = fixed_point(batch.column(0), scale, offset)
            for d in np.unique(size[takes]).tolist():
                _, x = fixed_point(batch.column(0), scale, offset, d)
                own = found.setdefault(d, [0, np.zeros(d, object)])
                own[0], own[1] = own[0] + len(x), own[1] + x.sum(axis=0).astype(object)
        for d, (n, total) in found.items():
            whole = [Decimal(int(v)) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int64()), pa.array(range(-1, d), pa.int64()), pa.array(whole, pa.decimal128(38, 0))], ["d", "i", "s"])

    parts = rows.select(F.col(f"`{column}`")).mapInArrow(run, "d long, i long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    each = parts.groupBy("d").agg(F.max(F.when(F.col("i") == -1, F.col("s"))).alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("sums"))
    most = each.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()  # one row of as many numbers as dimensions
    return (int(most[0]["n"]), [int(r["s"]) for r in most[0]["sums"][1:]]) if most else (0, [])


def _covariance(rows: DataFrame, column: str, n: int, sums: list[int], scale: int, offset: int) -> np.ndarray:
    """Covariance with divisor n. Vectors are centred at the whole part of the mean before multiplying; the rest of
    the mean is taken off exactly, and each entry is rounded once."""
    dims, whole = len(sums), np.array([s // n for s in sums], np.int64)
    row, col = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            _, x = fixed_point(batch.column(0), scale, offset, dims)
            total = total + _products(x - whole)
        upper = [Decimal(int(v)) for v in total[row, col]]
        yield pa.RecordBatch.from_arrays([pa.array(row * dims + col, pa.int64()), pa.array(upper, pa.decimal128(38, 0))], ["ij", "s"])

    found = rows.select(F.col(f"`{column}`")).mapInArrow(run, "ij long, s decimal(38,0)").groupBy("ij").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    rest = [s - n * int(w) for s, w in zip(sums, whole)]
    out = np.zeros((dims, dims))
    for r in found.collect():  # a row for each pair of dimensions
        i, j = divmod(r["ij"], dims)
        out[i, j] = out[j, i] = (n * int(r["s"]) - rest[i] * rest[j]) / (n * n)
    return out


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and the product Q of Householder reflections with v = Q T Q'."""
    a, d = v.astype(float).copy(), len(v)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x[0] += length if x[0] >= 0 else -length
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def count_below(main: np.ndarray, side: np.ndarray, x: float, tiny: float) -> int:
    """Eigenvalues of a tridiagonal matrix below x: the negative pivots of T - x (Sturm)."""
    found, pivot = 0, 1.0
    for i, a in enumerate(main.tolist()):
        pivot = a - x - (side[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        found += pivot < 0
    return found


def leading_eigenvalues(main: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection down to neighbouring doubles."""
    d = len(main)
    radius = np.concatenate([np.abs(side), [0.0]]) + np.concatenate([[0.0], np.abs(side)])
    low, high = float((main - radius).min()), float((main + radius).max())
    tiny = max(np.finfo(float).tiny * 1e4, np.finfo(float).eps * 1e-8 * max(abs(low), abs(high)))
    out = []
    for m in range(1, k + 1):
        a, b = low - tiny, (out[-1] if out else high) + tiny
        while True:
            mid = (a + b) / 2
            if not a < mid < b:
                break
            if d - count_below(main, side, mid, tiny) >= m:
                a = mid
            else:
                b = mid
        out.append(a)
    return np.array(out)


def _solve(main: np.ndarray, side: np.ndarray, x: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - x) y = right by elimination with row exchanges."""
    d = len(main)
    rows = np.zeros((d, 3))  # diagonal and two above it
    rows[:, 0] = main - x
    rows[:-1, 1] = side
    y = right.copy()
    below = side.copy()
    for i in range(d - 1):
        if abs(below[i]) > abs(rows[i, 0]):
            lower = np.array([below[i], rows[i + 1, 0], rows[i + 1, 1]])
            lower, rows[i] = rows[i].copy(), lower
            y[i], y[i + 1] = y[i + 1], y[i]
        else:
            lower = np.array([below[i], rows[i + 1, 0], rows[i + 1, 1]])
        if abs(rows[i, 0]) < tiny:
            rows[i, 0] = tiny
        f = lower[0] / rows[i, 0]
        rows[i + 1, 0], rows[i + 1, 1] = lower[1] - f * rows[i, 1], lower[2] - f * rows[i, 2]
        y[i + 1] -= f * y[i]
    if abs(rows[-1, 0]) < tiny:
        rows[-1, 0] = tiny
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - (rows[i, 1] * y[i + 1] if i + 1 < d else 0.0) - (rows[i, 2] * y[i + 2] if i + 2 < d else 0.0)) / rows[i, 0]
    return y


def eigenvectors(main: np.ndarray, side: np.ndarray, values: np.ndarray, seed: int = 3) -> np.ndarray:
    """Unit vectors of a tridiagonal matrix in columns. Inverse iteration from a random start; within a cluster each
    vector is made orthogonal to those before it in every step, and equal values are set apart by a few units of rounding."""
    rng, d = np.random.default_rng(seed), len(main)
    size = max(float(np.abs(values).max(initial=0)), float(np.abs(main).max(initial=0)), np.finfo(float).tiny * 1e8)
    eps = np.finfo(float).eps * size
    out = np.zeros((d, len(values)))
    cluster, shift = 0, np.inf
    for k, x in enumerate(values):
        if k and values[k - 1] - x > CLOSE * size:
            cluster = k
        shift = min(x, shift - eps) if k > cluster else x
        y = rng.standard_normal(d)
        for _ in range(6):
            y = _solve(main, side, shift, y, eps)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, cluster:k] @ (out[:, cluster:k].T @ y)
            y /= np.linalg.norm(y)
        out[:, k] = y
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and its unit eigenvectors in columns. Values that are
    no more than rounding beside the largest count as zero and are left out, with their vectors."""
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    main, side, q = tridiagonal(v)
    values = leading_eigenvalues(main, side, min(k, len(v)))
    values = values[values > max(values.max(initial=0), 0) * len(v) * np.finfo(float).eps * 8]
    vectors = q @ eigenvectors(main, side, values)
    for c in range(vectors.shape[1]):  # orthogonal to rounding, in place of what the reflections left
        for _ in range(2):
            vectors[:, c] -= vectors[:, :c] @ (vectors[:, :c].T @ vectors[:, c])
            vectors[:, c] /= np.linalg.norm(vectors[:, c])
    return values, vectors


@dataclass
class Whitening:
    """``n`` vectors with ``sums`` were fitted; ``values`` and ``vectors`` (in columns) are their covariance's."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    scale: int = SCALE
    offset: int = OFFSET

    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([(s % self.n) / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - sum)^2, as whole numbers of any size."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums)) < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
        else:
            d = self.n * x.astype(object) - np.array(self.sums, object)
        most = max(1, int(np.abs(d).max(initial=0)))
        d = d if most * most * d.shape[1] < 1 << 63 else d.astype(object)
        return [int(v) for v in (d * d).sum(axis=1)]


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The whitening of all vectors of ``column`` that take part (see ``fixed_point``)."""
    n, sums = _sums(rows, column, scale, offset)
    v = _covariance(rows, column, n, sums, scale, offset) if n else np.zeros((0, 0))
    values, vectors = leading_components(v, components)
    return Whitening(n, sums, float(np.trace(v)), values, vectors, scale, offset)


def transform(rows: DataFrame, model: Whitening, column: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Those rows whose vector takes part, with their projections (array<double>, one for each component) and
    their exact deviation (decimal(38,0), null where it has more digits). Columns of these two names are replaced. Null ids
    and repeated rows are kept; an empty table, or one without a usable vector, gives no rows."""
    names = [c for c in rows.columns if c.lower() not in (whitened.lower(), deviation.lower())]
    out = T.StructType([*[rows.schema[c] for c in names], T.StructField(whitened, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.DecimalType(38, 0))])
    sent, at = rows.sparkSession.sparkContext.broadcast(model), names.index(column)  # dimensions * components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if not model.n:
                continue
            takes, x = fixed_point(batch.column(at), model.scale, model.offset, len(model.sums))
            own = batch.filter(pa.array(takes))
            w = np.ascontiguousarray(model.whitened(x))
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            with localcontext() as c:
                c.prec = 60
                far = [Decimal(v) if v < 10**38 else None for v in model.deviation(x)]
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array(far, pa.decimal128(38, 0))], names=[*names, whitened, deviation])

    return rows.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, out)


def identity_error(rows: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    k = len(model.values)
    if not model.n or not k:
        return 0.0
    sent, dims = rows.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = sent.value.whitened(fixed_point(batch.column(0), sent.value.scale, sent.value.offset, dims)[1])
            total += np.concatenate([w.sum(0)[None], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.reshape(-1))], ["i", "s"])

    found = rows.select(F.col(f"`{column}`")).mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) * k)
    for r in found:  # (k + 1) * k numbers
        total[r["i"]] = r["s"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    error = identity_error(rows, model)
    ratio = F.array(*[F.lit(x) for x in model.explained()]).cast("array<double>")
    out = transform(rows, model).select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
    # the exact deviation as a long; null in a table so large that it has more than 63 bits, see deviation_exact
    short = F.when(F.col("deviation") <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), F.col("deviation")).cast("long")
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), short.alias("deviation"), "whitened",
        F.element_at(ratio, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
