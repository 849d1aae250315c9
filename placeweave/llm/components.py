"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One step. Large: each node's larger neighbours are tied to its smallest neighbour (or itself).
    Small: a node and its smaller neighbours are tied to the smallest of them."""
    if small:
        side = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = side.groupBy("u").agg(F.min("v").alias("m"))
        tied = side.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        side = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = side.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        tied = side.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of the edges ``a, b``; the component is its smallest node.
    Each round is written to the shared folder; a hub is only ever grouped by a minimum and joined."""
    state = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        state = written(_starred(_starred(state, small=False), small=True), "edges")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
