"""Smoothed densities on a grid and exact percentiles without a sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept

#: Values that are collected at most when a percentile's bin is down to a few, and bins of a histogram.
FEW, BINS = 1000, 1024


def kernel(sigma: float, reach: float = 4.0) -> list[float]:
    """Weights of a Gaussian from the centre outwards; both sides together sum to one."""
    size = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(size + 1)]
    whole = w[0] + 2 * sum(w[1:])
    return [x / whole for x in w]


def _along(cells: DataFrame, axis: str, size: int, weights: list[float]) -> DataFrame:
    """One pass: every cell hands its value on to its neighbours along an axis; what leaves the grid is mirrored at
    its border."""
    other = "cy" if axis == "cx" else "cx"
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(weights[abs(k)]).alias("w")) for k in range(1 - len(weights), len(weights))])
    moved = cells.withColumn("s", F.explode(steps)).withColumn("at", F.pmod(F.col(axis) + F.col("s.k"), F.lit(2 * size)))
    mirrored = F.when(F.col("at") < size, F.col("at")).otherwise(2 * size - 1 - F.col("at"))
    return moved.groupBy(mirrored.alias(axis), other).agg(F.sum(F.col("value") * F.col("s.w")).alias("value"))


def smoothed(cells: DataFrame, width: int, height: int, sigma: float) -> DataFrame:
    """``cx, cy, value`` of the cells that a Gaussian over ``cells`` (``cx, cy, value`` within the grid, each once) reaches:
    first along rows, then along columns, so a cell costs two kernels' lengths instead of their product."""
    w = kernel(sigma)
    return _along(_along(cells.select("cx", "cy", "value"), "cx", width, w), "cy", height, w)


def kth(values: DataFrame, column: str, k: int) -> float:
    """The k-th smallest value (from 0) of a column of finite doubles: histograms of the range that holds it, each of one
    bin of the last, until that bin has few values or only one."""
    own = values.select(F.col(column).cast("double").alias("v"))
    low, high = own.agg(F.min("v"), F.max("v")).first()
    while low < high:
        step = (high - low) / BINS
        at = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / step).cast("int")) if step and low + step > low else F.when(F.col("v") == low, 0).otherwise(1)
        bins = own.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # BINS rows at most
        for _, n, low, high in sorted(map(tuple, bins)):
            if k < n:
                break
            k -= n
        own = own.filter(F.col("v").between(low, high))
        if low < high and n <= FEW:
            return sorted(r["v"] for r in own.collect())[k]
    return low


def percentile(values: DataFrame, column: str, share: float, zeros: int = 0) -> float | None:
    """The percentile of a column of non-negative values and of so many zeros besides, between neighbours in proportion;
    None without any value."""
    n = values.count()
    if n + zeros == 0:
        return None
    place = share * (n + zeros - 1)
    below = math.floor(place)
    at = lambda k: 0.0 if k < zeros else kth(values, column, k - zeros)
    a = at(below)
    b = a if place == below else at(min(below + 1, n + zeros - 1))
    return a + (b - a) * (place - below)


def dense_cells(points: DataFrame, width: int, height: int, sigma: float, land: Column, water: DataFrame, share: float = 0.98, threshold: float = 0.18) -> DataFrame:
    """``cx, cy, density`` of the cells that are built up: occupied cells (of ``points``, ``cx, cy``; each counts once) are
    smoothed, divided by the percentile ``share`` over all land cells and cut at one; land cells above the threshold that are
    not in ``water`` (``cx, cy``) remain. ``land`` is a condition on ``cx, cy``. Points outside the grid are left out."""
    inside = F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1)
    cells = points.filter(inside).select("cx", "cy").distinct().withColumn("value", F.lit(1.0))
    dens = kept(smoothed(cells, width, height, sigma).filter(land), "density")
    grid = points.sparkSession.range(width * height).select((F.col("id") % width).alias("cx"), F.floor(F.col("id") / width).alias("cy"))
    zeros = grid.filter(land).count() - dens.count()
    ref = percentile(dens, "value", share, zeros) or 0.0
    scaled = F.least(F.lit(1.0), F.col("value") / ref) if ref > 0 else F.col("value")
    return dens.select("cx", "cy", scaled.alias("density")).filter(F.col("density") > threshold).join(water.select("cx", "cy").distinct(), ["cx", "cy"], "left_anti")
