"""How often each two members occur in the same group, without a row for each pair of each group.

Members are dealt into blocks. Each two blocks meet once, as two packed rows, and their pairs are counted in a table of one
block's members by the other's: the memory of a task is bounded by the size of a block, and what is shuffled grows with the
number of blocks, not with the pairs. The pairs themselves are the result, which is quadratic by nature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import kept

#: Members and rows of a block, at about. Pairs that are counted one by one, and rows that are handed on, at a time.
MEMBERS, ROWS, PAIRS, OUT = 3000, 1_000_000, 1 << 21, 1 << 17
#: A product over all members of two blocks takes this much less for a pair than counting it.
DENSE = 4000
_PACKED = "members binary, groups binary, sizes binary, at binary"


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: its members, its groups in order, their sizes, and their members by place, group by group."""
    members, at = np.unique(pdf["member"].to_numpy(), return_inverse=True)
    order = np.lexsort((at, pdf["grp"].to_numpy()))
    groups, sizes = np.unique(pdf["grp"].to_numpy(), return_counts=True)
    kind = np.uint16 if len(members) <= 1 << 16 else np.int32
    own = [members.astype(np.int64), groups.astype(np.int64), sizes.astype(np.int32), at[order].astype(kind)]
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], **{c: [x.tobytes()] for c, x in zip(("members", "groups", "sizes", "at"), own)}})


def _read(members: bytes, groups: bytes, sizes: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    members = np.frombuffer(members, np.int64)
    return members, np.frombuffer(groups, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(at, np.uint16 if len(members) <= 1 << 16 else np.int32).astype(np.int64)


def _counted(x: tuple, y: tuple) -> np.ndarray:
    """A table of the groups in common of each member of one block with each of another."""
    counts = np.zeros((len(x[0]), len(y[0])), np.int32)
    _, i, j = np.intersect1d(x[1], y[1], assume_unique=True, return_indices=True)
    start = [np.cumsum(s) - s for s in (x[2], y[2])]
    sizes = x[2][i], y[2][j]
    work = sizes[0] * sizes[1]
    if work.sum() * DENSE > counts.size * len(i):
        for k in range(0, len(i), 1024):
            one, two = (np.zeros((1024, len(s[0])), np.float32) for s in (x, y))
            for own, s, first, size, of in ((one, x, start[0], sizes[0], i), (two, y, start[1], sizes[1], j)):
                n = size[k : k + 1024]
                row = np.repeat(np.arange(len(n)), n)
                own[row, s[3][np.repeat(first[of[k : k + 1024]] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = 1
            counts += (one.T @ two).astype(np.int32)
        return counts
    flat, width = counts.reshape(-1), counts.shape[1]
    # each place of the one side with all of the other side's in its group
    n = np.repeat(sizes[1], sizes[0])
    left = x[3][np.repeat(start[0][i] - np.cumsum(sizes[0]) + sizes[0], sizes[0]) + np.arange(sizes[0].sum())] * width
    right = np.repeat(start[1][j], sizes[0])
    ends = np.cumsum(n)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PAIRS)) + 1).tolist(), len(n)]
    for a, b in zip(cuts, cuts[1:]):
        m = n[a:b]
        if len(m):
            np.add.at(flat, np.repeat(left[a:b], m) + y[3][np.repeat(right[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())], 1)
    return counts


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            x, y = _read(r.members, r.groups, r.sizes, r.at), _read(r.members2, r.groups2, r.sizes2, r.at2)
            counts = _counted(x, y)
            if r.i == r.j:
                np.fill_diagonal(counts, 0)
            step = max(1, OUT // counts.shape[1])
            for k in range(0, len(counts), step):
                a, b = np.nonzero(counts[k : k + step])
                a, b, n = x[0][a + k], y[0][b], counts[a + k, b].astype(np.int64)
                yield pd.DataFrame({"a": a, "b": b, "shared": n})
                if r.i != r.j:
                    yield pd.DataFrame({"a": b, "b": a, "shared": n})


def shared_groups(rows: DataFrame) -> DataFrame:
    """``a, b, shared``: for each two different members (both ways) of ``rows`` (``grp, member``, whole numbers) that have a
    group in common, how many they have. A row may occur more than once; nulls have no pairs."""
    c = kept(rows.select(F.col("grp").cast("long"), F.col("member").cast("long")).filter("grp is not null and member is not null").distinct(), "rows")
    size = c.agg(F.count("*").alias("n"), F.approx_count_distinct("member").alias("members")).first()
    blocks = max(1, -(-size["members"] // MEMBERS), -(-size["n"] // ROWS))
    packed = kept(c.withColumn("block", F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_packed, f"block int, {_PACKED}"), "blocks")
    left = packed.withColumnRenamed("block", "i").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))))
    right = packed.toDF("j", "members2", "groups2", "sizes2", "at2").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    pairs = min(blocks * (blocks + 1) // 2, 100_000)
    # a task for each two blocks, at about: a row of them is as large as both
    left, right = (side.repartition(pairs, "i", "j") for side in (left, right))
    return left.hint("merge").join(right, ["i", "j"]).mapInPandas(_rows, "a long, b long, shared long")
