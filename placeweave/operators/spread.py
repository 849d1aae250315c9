"""Extent and density of groups of points, without comparing all their members with each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import kept
from .match import salted

#: Points that a task keeps before it hands on its hulls so far, and parts in which partial hulls of a group first meet.
HELD, PARTS = 200_000, 64


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y), counter-clockwise; all distinct points if they are one or two."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(order) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    own = p.tolist()
    lower, upper = chain(own), chain(own[::-1])
    return np.array(lower[:-1] + upper[:-1])


def diameter(corners: np.ndarray, scale: tuple[float, float]) -> float:
    """The largest distance between corners of a hull, with x and y scaled; opposite corners are walked round once."""
    n = len(corners)
    if n < 2:
        return 0.0
    c = (corners * np.array(scale)).tolist()
    apart = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    if n == 2:
        return apart(c[0], c[1])
    area = lambda a, b, q: abs((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]))
    best, j = 0.0, 1
    for i in range(n):
        a, b = c[i], c[(i + 1) % n]
        best = max(best, apart(a, c[j]), apart(b, c[j]))
        while area(a, b, c[(j + 1) % n]) >= area(a, b, c[j]):
            j = (j + 1) % n
            best = max(best, apart(a, c[j]), apart(b, c[j]))
            if j == i:
                break
    return best


_CORNERS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
#: Points below which a group is handed on as it is.
SMALL = 16


@F.pandas_udf(_CORNERS)
def _hulled(lists: pd.Series) -> pd.Series:
    def one(points) -> list[dict]:
        own = hull(np.array([(p["lon"], p["lat"]) for p in points]))
        return [{"lon": x, "lat": y} for x, y in own.tolist()]

    return lists.map(one)


def hulls(points: DataFrame, by: str) -> DataFrame:
    """``by, lon, lat``: the corners of each group's hull. Tasks hand on the hulls of what they have read, which meet in
    parts and then as a whole, so no group is gathered in one task."""
    kind = T.StructType([points.schema[by], T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
    plain = points.select(by, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).filter("lon is not null and lat is not null")

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf.groupby(by, dropna=False, sort=False)[by].transform("size")
        out = [pdf[size < SMALL]]
        for _, own in pdf[size >= SMALL].groupby(by, dropna=False, sort=False):
            corners = hull(own[["lon", "lat"]].to_numpy())
            out.append(pd.DataFrame({by: [own[by].iloc[0]] * len(corners), "lon": corners[:, 0], "lat": corners[:, 1]}))
        return pd.concat(out)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(reduced(pdf))
            if sum(map(len, held)) > HELD:
                held = [reduced(pd.concat(held))]
                if len(held[0]) > HELD // 2:
                    yield held.pop()
        if held:
            yield reduced(pd.concat(held))

    def met(rows: DataFrame, *keys: str) -> DataFrame:
        lists = rows.groupBy(*keys).agg(F.collect_list(F.struct("lon", "lat")).alias("p"))
        return lists.select(by, F.explode(_hulled("p")).alias("p")).select(by, "p.lon", "p.lat")

    parts = plain.mapInPandas(partial, kind).withColumn("_part", F.pmod(F.xxhash64("lon", "lat"), F.lit(PARTS)))
    return met(met(parts, by, "_part"), by)


def spreads(corners: DataFrame, by: str, scale: tuple[float, float]) -> DataFrame:
    """``by, corners, spread``: number of corners and largest distance, from hulls."""

    @F.pandas_udf("corners long, spread double")
    def measured(lists: pd.Series) -> pd.DataFrame:
        own = [hull(np.array([(p["lon"], p["lat"]) for p in x])) for x in lists]
        return pd.DataFrame({"corners": [len(x) for x in own], "spread": [diameter(x, scale) for x in own]})

    lists = corners.groupBy(by).agg(F.collect_list(F.struct("lon", "lat")).alias("p"))
    return lists.select(by, measured("p").alias("m")).select(by, "m.corners", "m.spread")


def chapter_clusters(candidates: DataFrame, anchors: DataFrame, scale: tuple[float, float], most_m: float = 500.0, top: float = 0.72, fall: float = 0.17) -> DataFrame:
    """``id, lon, lat, anchors, spread, conf`` of each candidate (``id, chapters``) whose chapters' anchors (``chapter, lon,
    lat``) stand at two places or more that lie at most ``most_m`` apart: their centre, with a confidence that falls with the
    spread. Candidates of equal chapters are one class; a class meets only the hulls of its chapters until the spread is known."""
    key = F.md5(F.concat_ws(",", F.array_sort(F.array_distinct("chapters")).cast("array<string>")))
    own = candidates.select("id", key.alias("cls"), "chapters")
    classes = own.groupBy("cls").agg(F.first("chapters").alias("chapters")).select("cls", F.explode(F.array_distinct("chapters")).alias("chapter"))
    spots = anchors.select("chapter", "lon", "lat").distinct()
    met = classes.join(hulls(spots, "chapter"), "chapter").select("cls", "lon", "lat")
    near = spreads(hulls(met, "cls"), "cls", scale).filter((F.col("corners") >= 2) & (F.col("spread") <= most_m))
    inside = classes.join(near.select("cls"), "cls", "left_semi").join(spots, "chapter").select("cls", "lon", "lat").distinct()
    centre = inside.groupBy("cls").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("anchors"))
    out = centre.join(near.select("cls", "spread"), "cls").withColumn("conf", top - fall * F.col("spread") / most_m)
    return salted(own.select("id", "cls"), out, ["cls"], F.col("id")).select("id", "lon", "lat", "anchors", "spread", "conf")


#: Cells to a radius at which balls are bounded first, the factor from one bound to the next, the finest bound, and the
#: finest cells whose points are compared. A look-up takes about as long as so many comparisons.
FIRST, FINER, FINEST, COMPARED, LOOK_UP = 2, 4, 32, 8, 20


def _across(parts: int) -> list[tuple[int, int, int]]:
    """``j, whole, reach`` of each row of cells (``parts`` to the radius) around a cell: how far to both sides cells lie within
    the radius as a whole (-1: none does), and how far any of their points may."""
    whole = lambda j: max((i for i in range(parts) if (i + 1) ** 2 + (abs(j) + 1) ** 2 < parts**2), default=-1)
    reach = lambda j: max(i for i in range(parts + 2) if max(i - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= parts**2)
    return [(j, whole(j), reach(j)) for j in range(-parts - 1, parts + 2)]


def _bounds(cells: DataFrame, centres: DataFrame, by: str, parts: int) -> DataFrame:
    """``by, cx, cy, n, low, high`` of the cells ``centres``: how many points a ball around any of its points holds at least
    and at most. Counts along each row of cells are summed up once; a row of a ball is a difference of two of these sums."""
    ends = []
    for j, whole, reach in _across(parts):
        ends += [(j, reach, 0, 1), (j, -reach - 1, 0, -1)]
        ends += [(j, whole, 1, 0), (j, -whole - 1, -1, 0)] if whole >= 0 else []
    ends = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for j, i, low, high in ends])
    asked = centres.withColumn("o", F.explode(ends)).select(by, (F.col("cy") + F.col("o.j")).alias("y"), (F.col("cx") + F.col("o.i")).alias("x"), F.lit(0).cast("long").alias("n"), "cx", "cy", F.col("n").alias("own"), "o.low", "o.high")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cx", "long"), ("cy", "long"), ("own", "long"), ("low", "int"), ("high", "int"))]
    so_far = F.sum("n").over(Window.partitionBy(by, "y").orderBy("x", F.col("cx").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    met = cells.select(by, F.col("cy").alias("y"), F.col("cx").alias("x"), "n", *none).unionByName(asked).withColumn("sum", so_far).filter("cx is not null")
    return met.groupBy(by, "cx", "cy").agg(F.max("own").alias("n"), F.sum(F.col("low") * F.col("sum")).alias("low"), F.sum(F.col("high") * F.col("sum")).alias("high"))


def largest_balls(points: DataFrame, by: str, radius_m: float, distance: Callable[..., Column], scale: tuple[float, float], least: int = 2) -> DataFrame:
    """``by, id, n, lon, lat``: in each group the point (``by, id, lon, lat``) with the most points of its group within
    the radius, itself included (ties: the smallest id), how many they are and their mean place. Balls are bounded by the
    counts of cells, finer ones in turn: a cell whose bound lies below what a ball is known to hold is out before any of its
    points is compared. Of what is left, cells that lie within the radius as a whole are taken from their counts, and only
    points of cells at the edge are compared; cells are made finer while that costs less than it saves."""
    p = kept(points.select(by, "id", "lon", "lat").filter(f"`{by}` is not null and lon is not null and lat is not null"), "points")
    side = lambda c, s, parts: F.floor(F.col(c) * s / (radius_m / parts))
    celled = lambda parts: p.withColumn("cx", side("lon", scale[0], parts)).withColumn("cy", side("lat", scale[1], parts))
    here, there = [F.col(c) for c in ("lon", "lat")], [F.col(c) for c in ("lon2", "lat2")]
    square = sum(((a - b) * s) * ((a - b) * s) for a, b, s in zip(here, there, scale))
    # the exact distance only where it matters
    near = (square <= radius_m**2 * (1 - 1e-9)) | ((square <= radius_m**2 * (1 + 1e-9)) & (distance(*here, *there) <= radius_m))

    def ball(centre: DataFrame) -> DataFrame:
        """The points around one point of each group."""
        return salted(p.select(by, F.col("id").alias("id2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), centre, [by], F.col("id2")).filter(near)

    live, parts = None, FIRST
    while True:
        cells = celled(parts).groupBy(by, "cx", "cy").agg(F.count("*").alias("n"))
        up = [F.floor(F.col(c) / FINER).alias(c) for c in ("cx", "cy")]
        centres = cells if live is None else cells.withColumn("up", F.struct(*up)).join(live.select(by, F.struct("cx", "cy").alias("up")), [by, "up"]).drop("up")
        bound = kept(_bounds(cells, centres, by, parts), "bounds")
        most = bound.groupBy(by).agg(F.max("low").alias("low"), F.max_by(F.struct("cx", "cy"), F.struct(F.col("low") + F.col("high"), "cx", "cy")).alias("c"))
        seed = celled(parts).join(most.select(by, "c.cx", "c.cy"), [by, "cx", "cy"]).groupBy(by).agg(F.min(F.struct("id", "lon", "lat")).alias("s"))
        known = ball(seed.select(by, "s.lon", "s.lat")).groupBy(by).agg(F.count("*").alias("known"))
        best = most.join(known, by).select(by, F.greatest("low", "known", F.lit(least)).alias("best"))
        live = kept(bound.join(best, by).filter("high >= best").drop("best"), "live")
        if parts <= COMPARED:
            compared, lows = parts, live.select(by, "cx", "cy", "low")
        work = live.agg(F.sum(F.col("n") * (F.col("high") - F.col("low"))).alias("pairs"), F.least(F.count("*") * FINER**2, F.sum("n")).alias("cells")).first()
        if parts * FINER > FINEST or not work["pairs"] or work["pairs"] <= LOOK_UP * work["cells"] * 8 * parts * FINER:
            break
        parts *= FINER
    offsets = [(i, j) for j, whole, reach in _across(compared) for i in range(-reach, reach + 1) if abs(i) > whole]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    own = celled(parts).join(live.select(by, "cx", "cy"), [by, "cx", "cy"]).select(by, "id", "lon", "lat")
    own = own.withColumn("cx", side("lon", scale[0], compared)).withColumn("cy", side("lat", scale[1], compared))
    other = celled(compared).select(by, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    wide = own.withColumn("o", F.explode(around)).select(by, "id", "lon", "lat", (F.col("cx") + F.col("o.i")).alias("x2"), (F.col("cy") + F.col("o.j")).alias("y2"))
    # exploded rows count as one in Spark's estimate, which would broadcast them
    edge = wide.hint("merge").join(other, [by, "x2", "y2"]).filter(near).groupBy(by, "id").agg(F.count("*").alias("n2"))
    full = own.join(lows, [by, "cx", "cy"]).join(edge, [by, "id"], "left").select(by, "id", "lon", "lat", (F.col("low") + F.coalesce("n2", F.lit(0))).alias("n"))
    top = full.filter(F.col("n") >= least).groupBy(by).agg(F.max(F.struct("n", (-F.col("id")).alias("back"), "id", "lon", "lat")).alias("b"))
    top = kept(top.select(by, "b.id", "b.n", "b.lon", "b.lat"), "balls")
    return ball(top).groupBy(by, "id", "n").agg(F.avg("lon2").alias("lon"), F.avg("lat2").alias("lat"))


def prefix_members(stems: DataFrame, names: DataFrame, stem: str, name: str) -> DataFrame:
    """Each stem with each row of ``names`` whose longer name starts with it: names are cut at the lengths that stems
    have, one level of a trie each, and meet their stems by equality."""
    sizes = sorted(r["n"] for r in stems.select(F.length(stem).alias("n")).distinct().collect() if r["n"])  # as many as the longest stem has characters
    if not sizes:
        return stems.join(names.limit(0))
    levels = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n < F.length(name))
    cut = names.withColumn("_cut", F.explode(F.transform(levels, lambda n: F.col(name).substr(F.lit(1), n))))
    return salted(cut, stems.withColumn("_cut", F.col(stem)), ["_cut"], F.col(name)).drop("_cut")
