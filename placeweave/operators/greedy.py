"""Greedy choices in a given order, made in parallel rounds with the result of the sequential walk.

A walk that takes each item unless an earlier taken one forbids it takes the lexicographically first independent set
of the conflict graph. An item without an undecided earlier neighbour is taken at once, its later neighbours are out;
rounds repeat until nothing is undecided.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .match import salted

#: Rounds after which chains of items that wait for one another are resolved by doubling.
PLAIN_ROUNDS = 3


def _chains(live: DataFrame) -> DataFrame:
    """``node`` whose status, over a chain of nodes that each wait for one other, equals that of the chain's ``end``."""
    now = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("end"), F.count("*").alias("n")).filter("n = 1")
    now = kept(now.select("node", "end", F.lit(1).alias("turn")), "chain")
    while True:
        nxt = now.select(F.col("node").alias("end"), F.col("end").alias("end2"), F.col("turn").alias("turn2"))
        new = now.join(nxt, "end", "left")
        new = kept(new.select("node", F.coalesce("end2", "end").alias("end"), ((F.col("turn") + F.coalesce("turn2", F.lit(0))) % 2).alias("turn"), F.col("end2").isNotNull().alias("moved")), "chain")
        now = new.select("node", "end", "turn")
        if not new.filter("moved").limit(1).count():
            return now.filter("turn = 0").select("node", "end")


def first_independent(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """The taken ``node``s of a walk; ``before`` has the edges ``a, b`` of which a comes first."""
    free, live, taken, turn = kept(nodes.select("node").distinct(), "free"), kept(before.distinct(), "live"), None, 0
    while free.limit(1).count():
        waits = live.select(F.col("b").alias("node")).distinct()
        won = free.join(waits, "node", "left_anti")
        if turn >= PLAIN_ROUNDS:
            won = won.union(_chains(live).join(won.withColumnRenamed("node", "end"), "end", "left_semi").select("node"))
        won = kept(won, "won")
        out = live.join(won.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        taken = won if taken is None else taken.union(won)
        free = kept(free.join(won, "node", "left_anti").join(out, "node", "left_anti"), "free")
        live = kept(live.join(free.withColumnRenamed("node", "a"), "a", "left_semi").join(free.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"), "live")
        turn += 1
    return nodes.select("node").distinct() if taken is None else taken


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, centre``: walking ``nodes`` (``node, rank``, ranks unique) in order, each node that none has taken yet
    becomes a centre and takes all its later neighbours (``edges`` ``a, b``, either way round) that are still free."""
    rank = nodes.select("node", "rank")
    ends = edges.select("a", "b").union(edges.select("b", "a"))
    ends = ends.join(rank.withColumnsRenamed({"node": "a", "rank": "ra"}), "a").join(rank.withColumnsRenamed({"node": "b", "rank": "rb"}), "b")
    before = kept(ends.filter("ra < rb").select("a", "b", "ra").distinct(), "before")
    taken = first_independent(rank, before.select("a", "b"))
    first = before.join(taken.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min_by("a", "ra").alias("centre"))
    return rank.select("node").join(first, "node", "left").select("node", F.coalesce("centre", "node").alias("centre"))


def _near(points: DataFrame, heads: DataFrame, spacing: float, side: float) -> DataFrame:
    """Each point with each head (renamed: rank2, x2, y2) of its group that lies nearer than ``spacing``. A cell has
    one head at most, so a point meets at most those of the 25 cells around it."""
    shift = F.array(*[F.lit(k) for k in range(-2, 3)])
    around = heads.withColumn("cx", F.explode(F.transform(shift, lambda k: F.floor(F.col("x2") / side) + k))).withColumn("cy", F.explode(F.transform(shift, lambda k: F.floor(F.col("y2") / side) + k)))
    met = salted(points, around, ["name", "cx", "cy"], F.col("rank"))
    return met.filter((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) < spacing * spacing)


def spaced(points: DataFrame, spacing: float, most: int) -> DataFrame:
    """Walking the points (``name, rank, x, y``; ranks unique within a name) of each name in order, a point is taken
    unless a taken one of its name lies nearer than ``spacing``, up to ``most`` of a name. No list of conflicting pairs
    is made: points of one cell of a grid all conflict, so only the first free one of each cell can be taken in a round,
    and every point meets these few heads."""
    side = spacing / math.sqrt(2) * (1 - 1e-9)
    same = points.groupBy("name", "x", "y").agg(F.min("rank").alias("rank"))  # a later point at the same place never counts
    free = kept(same.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)), "free")
    taken = None
    while free.limit(1).count():
        heads = free.groupBy("name", "cx", "cy").agg(F.min(F.struct("rank", "x", "y")).alias("h")).select("name", F.col("h.rank").alias("rank2"), F.col("h.x").alias("x2"), F.col("h.y").alias("y2"))
        heads = kept(heads, "heads")
        later = _near(free, heads, spacing, side).filter("rank < rank2").select("name", "rank2").distinct()
        won = kept(heads.join(later, ["name", "rank2"], "left_anti"), "won")
        gone = _near(free, won, spacing, side).select("name", "rank").distinct()
        own = won.select("name", F.col("rank2").alias("rank"))
        taken = own if taken is None else taken.union(own)
        # a name with enough taken points needs none behind the last of them
        last = taken.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("rank"))).filter(F.col("k") == most).select("name", F.col("rank").alias("last"))
        rest = free.join(gone, ["name", "rank"], "left_anti")
        enough = rest.groupBy("name").agg(F.min("rank").alias("least")).join(last, "name", "left").filter("last is null or least < last").select("name", "last")
        free = kept(salted(rest, enough, ["name"], F.col("rank")).filter("last is null or rank < last").drop("last"), "free")
    if taken is None:
        return points.select("name", "rank").limit(0)
    return taken.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("rank"))).filter(F.col("k") <= most).select("name", "rank")



def unoccupied(items: DataFrame) -> DataFrame:
    """Walking the items (``node, rank, cells``; ranks unique) in order, an item is taken unless one of its cells is occupied
    by a taken one, and then occupies them: the ``node``s taken. An item is taken at once if it comes first in all of its cells;
    whoever shares a cell with it is out. Items only meet their cells, never each other. Without cells an item is taken."""
    taken = items.filter(F.coalesce(F.size("cells"), F.lit(0)) == 0).select("node")
    free = kept(items.select("node", "rank", F.explode(F.array_distinct("cells")).alias("cell")), "free")
    while free.limit(1).count():
        first = free.groupBy("cell").agg(F.min("rank").alias("first"))
        met = kept(salted(free, first, ["cell"], F.col("node")), "met")
        won = kept(met.groupBy("node").agg(F.bool_and(F.col("rank") == F.col("first")).alias("won")).filter("won").select("node"), "won")
        full = free.join(won, "node", "left_semi").select("cell").distinct()
        out = salted(free, full, ["cell"], F.col("node")).select("node").distinct()
        free = kept(free.join(out, "node", "left_anti"), "free")
        taken = taken.union(won)
    return taken
