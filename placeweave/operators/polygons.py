"""Points in polygons by a cover of grid cells.

Each ring marks the cells that its edges pass (border) and the cells that it encloses (inside). A point in an inside
cell is in the ring at once. In a border cell the point is compared with its cell's centre, whose side is known: the
way between them, first level, then upright, crosses some of the cell's own edges, and an odd number of crossings turns
the side over. So a ring of any size costs a point only the edges in its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .match import dealt, salted, sized
from .numbering import numbered


def edges(rings: DataFrame) -> DataFrame:
    """``ring, x1, y1, x2, y2`` of closed rings from their vertices ``ring, pos, lon, lat``. A last vertex equal to the
    first adds an edge of no length, which crosses nothing. Rings of fewer than three vertices enclose nothing. Vertices are
    numbered by ranges and meet their followers by number, so a ring of any size is spread over tasks."""
    v = numbered(rings.filter("lon is not null and lat is not null").select("ring", "pos", "lon", "lat"), ["pos", "lon", "lat"], by=["ring"], name="k")
    v = kept(v.select("ring", "k", "lon", "lat"), "vertices")
    nxt = v.select("ring", (F.col("k") - 1).alias("k"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    first = v.groupBy("ring").agg(F.count("*").alias("n"), F.min_by("lon", "k").alias("x0"), F.min_by("lat", "k").alias("y0")).filter("n >= 3")
    e = salted(v.join(nxt, ["ring", "k"], "left"), first, ["ring"], F.col("k"))
    return e.select("ring", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.coalesce("x2", "x0").alias("x2"), F.coalesce("y2", "y0").alias("y2"))


#: Cells are at most so many times finer than asked for. What an edge costs in one more cell, and in one more that holds
#: points, in comparisons of a point with an edge.
FINEST, PASSED, LISTED = 32, 3, 64


def fitting(sides: DataFrame, n: int, cell: float) -> float:
    """``cell``, halved as long as that costs less for the edges than it saves for ``n`` points: in half as wide cells an edge
    passes up to twice as many of them, and a point meets about half as many edges."""
    x, y = (F.abs(F.col(f"{c}1") - F.col(f"{c}2")) for c in "xy")
    ends = [f(g(f"{c}1", f"{c}2")).alias(f"{c}{k}") for c in "xy" for k, f, g in (("a", F.min, F.least), ("b", F.max, F.greatest))]
    by_ring = sides.groupBy("ring").agg(F.count("*").alias("n"), F.sum(x + y).alias("way"), *ends).withColumn("area", (F.col("xb") - F.col("xa")) * (F.col("yb") - F.col("ya")))
    r = by_ring.agg(F.sum("n").alias("n"), F.sum("way").alias("way"), F.sum("area").alias("area"), F.min("xa").alias("xa"), F.max("xb").alias("xb"), F.min("ya").alias("ya"), F.max("yb").alias("yb")).first()
    if not r["n"]:
        return cell

    def cost(c: float) -> float:
        cells = ((r["xb"] - r["xa"]) / c + 1) * ((r["yb"] - r["ya"]) / c + 1)
        pieces, inside = r["n"] + r["way"] / c, r["area"] / c**2
        return (pieces + inside) * (PASSED + LISTED * min(1.0, n / cells)) + n * pieces / cells

    return min((cell / 2**k for k in range(FINEST.bit_length())), key=lambda c: (cost(c), -c))


def cover(sides: DataFrame, cell: float, used: DataFrame) -> DataFrame:
    """``ring, cx, cy, within, parts``: the cells of each ring, of those that ``used`` (``cx, cy``) has. ``within`` is the side
    of the cell's centre; ``parts`` are the edges that pass the cell, null for an inside cell."""
    used = sized(used)
    row = lambda y: F.floor(y / cell)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = sides.withColumn("cy", F.explode(F.sequence(row(low), row(high))))
    # the piece of the edge between the row's lower and upper line
    flat = F.col("y1") == F.col("y2")
    at = lambda y: F.when(flat, F.col("x1")).otherwise((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    a, b = at(F.greatest(low, F.col("cy") * cell)), F.when(flat, F.col("x2")).otherwise(at(F.least(high, (F.col("cy") + 1) * cell)))
    slack = cell * 1e-9  # a cell too many does no harm, its edges aren't on the way to its centre
    e = e.withColumn("cx", F.explode(F.sequence(row(F.least(a, b) - slack), row(F.greatest(a, b) + slack)))).join(used, ["cx", "cy"], "left_semi")
    border = e.groupBy("ring", "cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("parts"))
    # crossings of the level line through the rows' centres; between the first and the second, the third and the fourth ... is inside
    mid_y = (F.col("cy") + 0.5) * cell
    rows = sides.withColumn("cy", F.explode(F.sequence(row(low), row(high)))).filter((F.col("y1") > mid_y) != (F.col("y2") > mid_y))
    cut = rows.select("ring", "cy", ((F.col("x2") - F.col("x1")) * (mid_y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    order = Window.partitionBy("ring", "cy").orderBy("x")
    spans = cut.select("ring", "cy", "x", F.lead("x").over(order).alias("x_end"), F.row_number().over(order).alias("k")).filter("k % 2 = 1")
    # centres c with x <= c < x_end: those that an odd number of crossings lies to the right of
    first, last = F.ceil(F.col("x") / cell - 0.5), F.ceil(F.col("x_end") / cell - 0.5) - 1
    held = spans.filter(last >= first).select("ring", F.explode(F.sequence(first, last)).alias("cx"), "cy").join(used, ["cx", "cy"], "left_semi").withColumn("within", F.lit(True)).distinct()
    return border.join(held, ["ring", "cx", "cy"], "full").select("ring", "cx", "cy", F.coalesce("within", F.lit(False)).alias("within"), "parts")


def in_rings(points: DataFrame, rings: DataFrame, cell: float) -> DataFrame:
    """Each row of ``points`` (``lon, lat``) with each ``ring`` that holds it: an odd number of the ring's edges lies to the
    right of the point. ``rings`` has ``ring, pos, lon, lat``. Points without coordinates are in no ring. ``cell`` is the side of
    the widest cells; where there are many edges and points they are finer. A cell that holds a large share of the points
    is dealt."""
    return held_by_rings(points, kept(edges(rings), "sides"), cell)


def held_by_rings(points: DataFrame, sides: DataFrame, cell: float) -> DataFrame:
    """The same from the rings' edges (``ring, x1, y1, x2, y2``), which are read several times."""
    own = kept(points.filter("lon is not null and lat is not null").withColumn("row", F.monotonically_increasing_id()), "points")
    cell = fitting(sides, own.count(), cell)
    own = own.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    cells = cover(sides, cell, kept(own.select("cx", "cy").distinct(), "used"))
    met = dealt(own, cells, ["cx", "cy"], F.col("row"))
    mid_x, mid_y = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    side = [F.col(f"e.{c}") for c in ("x1", "y1", "x2", "y2")]

    def turns(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        """Whether the edge is crossed once on the way from the point to below or above the centre, and from there to it."""
        right = lambda x: ((y1 > F.col("lat")) != (y2 > F.col("lat"))) & (x < (x2 - x1) * (F.col("lat") - y1) / (y2 - y1) + x1)
        above = lambda y: ((x1 > mid_x) != (x2 > mid_x)) & (y < (y2 - y1) * (mid_x - x1) / (x2 - x1) + y1)
        return (right(F.col("lon")) != right(mid_x)) != (above(F.col("lat")) != above(mid_y))

    # a row for each crossing, and one more where the centre is inside: an odd number of them is inside
    none = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    parts = F.coalesce("parts", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    each = met.withColumn("e", F.explode(F.when(F.col("within"), F.array_append(parts, none)).otherwise(parts))).filter(F.col("e").isNull() | turns(*side))
    return each.groupBy(*points.columns, "row", "ring").agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*points.columns, "ring")


def in_polygons(points: DataFrame, rings: DataFrame, cell: float, key: str) -> DataFrame:
    """``key, polygon`` of the points in each polygon: in one of its outer rings and in none of its holes. ``rings`` has
    ``polygon, ring, hole, pos, lon, lat``; ring ids are unique over all polygons."""
    return held_by_polygons(points, kept(edges(rings), "sides"), rings.select("ring", "polygon", "hole").distinct(), cell, key)


def held_by_polygons(points: DataFrame, sides: DataFrame, of: DataFrame, cell: float, key: str) -> DataFrame:
    """The same from the rings' edges and the table ``of`` of their polygons (``ring, polygon, hole``)."""
    held = held_by_rings(points.select(key, "lon", "lat"), sides, cell).select(key, "ring").join(of, "ring")
    return held.groupBy(key, "polygon").agg(F.bool_or(~F.col("hole")).alias("outer"), F.bool_or("hole").alias("hole")).filter("outer and not hole").select(key, "polygon")
