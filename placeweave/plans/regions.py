"""Queries: points in a table of polygons, and what builds on it."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import density as dn
from placeweave.operators import polygons as pg
from placeweave.operators.graph import kept

from .base import ANCHORS, PLACES, anchors, hash_point, places, query, read, sql_point

#: Side of a cell of the cover, in degrees.
CELL = 0.01
#: Places of each kind that are looked up first.
FIRST_RANKS = 480
_TURN = 2 * math.pi

# A nation's polygon: two outer rings and a hole. A customer is a vertex of one of them; a hash gives its angle (its
# place in the ring) and its way from the centre.
_U = "(CAST(CAST('0x' || substr(sha256(c_name || 'v'), {}, 6) AS BIGINT) AS DOUBLE) / 16777216.0)"
_RING = f"""(SELECT c_nationkey AS polygon, c_nationkey * 10 + c_custkey % 3 AS ring, c_custkey % 3 = 2 AS hole, {_U.format(1)} AS pos,
 m.lon + CASE c_custkey % 3 WHEN 2 THEN 0.025 ELSE 0.07 END * (0.4 + 0.6 * {_U.format(7)}) * cos({_TURN} * {_U.format(1)}) + CASE c_custkey % 3 WHEN 1 THEN 0.05 ELSE 0 END AS lon,
 m.lat + CASE c_custkey % 3 WHEN 2 THEN 0.025 ELSE 0.07 END * (0.4 + 0.6 * {_U.format(7)}) * sin({_TURN} * {_U.format(1)}) AS lat
 FROM customer JOIN (SELECT n_nationkey, {sql_point('n_name')} FROM nation) m ON n_nationkey = c_nationkey)"""
_EDGES = f"(SELECT ring, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2, count(*) OVER (PARTITION BY ring) AS n FROM {_RING} v WINDOW w AS (PARTITION BY ring ORDER BY pos))"


def rings(spark, d):
    """polygon, ring, hole, pos, lon, lat."""
    lon, lat = hash_point(F.col("n_name"))
    m = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), lon.alias("mx"), lat.alias("my"))
    h = F.sha2(F.concat("c_name", F.lit("v")), 256)
    u = lambda k: F.conv(F.substring(h, k, 6), 16, 10).cast("long") / F.lit(16777216.0)
    part = F.col("c_custkey") % 3
    way = F.when(part == 2, 0.025).otherwise(0.07) * (0.4 + 0.6 * u(7))
    c = read(spark, d, "customer").join(m, "c_nationkey")
    return c.select(
        F.col("c_nationkey").alias("polygon"), (F.col("c_nationkey") * 10 + part).alias("ring"), (part == 2).alias("hole"), u(1).alias("pos"),
        (F.col("mx") + way * F.cos(_TURN * u(1)) + F.when(part == 1, 0.05).otherwise(0.0)).alias("lon"), (F.col("my") + way * F.sin(_TURN * u(1))).alias("lat"),
    )


_SPOT = f"(SELECT o_orderkey AS id, {sql_point('CAST(o_orderkey AS VARCHAR)')} FROM orders)"


def _in(points: str, key: str) -> str:
    hits = f"SELECT {key}, ring FROM {points} p JOIN {_EDGES} e ON n >= 3 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1"
    return f"(SELECT {key}, polygon FROM ({hits}) h JOIN (SELECT DISTINCT ring, polygon, hole FROM {_RING} r) r USING (ring) GROUP BY ALL HAVING bool_or(NOT hole) AND NOT bool_or(hole))"


@query("j15_polygon_table", f"SELECT id, polygon FROM {_in(_SPOT, 'id')} x")
def j15_table(spark, d):
    lon, lat = hash_point(F.col("o_orderkey"))
    points = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), lon.alias("lon"), lat.alias("lat"))
    return pg.in_polygons(points, rings(spark, d), CELL, "id")


_KIND = "CASE seg WHEN 'BUILDING' THEN 'gov' WHEN 'AUTOMOBILE' THEN 'transit' WHEN 'FURNITURE' THEN 'mall' WHEN 'HOUSEHOLD' THEN 'park' END"
_TOP_UP = f"(SELECT place_id, name, {_KIND} AS kind, round(lon, 4) AS lon, round(lat, 4) AS lat, score FROM {PLACES} p WHERE place_id IN (SELECT place_id FROM {_in(PLACES, 'place_id')} q))"


@query("e23_bounded_top_up", f"WITH k(kind, ord) AS (VALUES ('mall', 1), ('gov', 2), ('park', 3), ('transit', 4)), c AS (SELECT name, kind, lon, lat, row_number() OVER (PARTITION BY kind ORDER BY name, lon, lat) AS rn FROM {_TOP_UP} t WHERE kind IS NOT NULL AND score <= 9000 AND regexp_matches(name, '[A-Za-z]') AND regexp_matches(name, '[0-9]')) SELECT name, kind, lon, lat FROM c JOIN k USING (kind) ORDER BY rn, ord LIMIT 120")
def e23_bounded(spark, d):
    """Places inside a boundary that aren't known yet (here: with a high score), with both scripts in their name and a
    kind by tag; the kinds take turns in a fixed order until 120 are found."""
    p = places(spark, d)
    kind = F.when(F.col("seg") == "BUILDING", "gov").when(F.col("seg") == "AUTOMOBILE", "transit").when(F.col("seg") == "FURNITURE", "mall").when(F.col("seg") == "HOUSEHOLD", "park")
    c = p.filter("score <= 9000 and name rlike '[A-Za-z]' and name rlike '[0-9]'").withColumn("kind", kind).filter("kind is not null")
    c = kept(c.select("place_id", "name", "kind", F.round("lon", 4).alias("lon4"), F.round("lat", 4).alias("lat4"), "lon", "lat"), "wanted")
    sides = kept(pg.edges(rings(spark, d)), "sides")
    of = kept(rings(spark, d).select("ring", "polygon", "hole").distinct(), "rings")
    turn = Window.partitionBy("kind").orderBy("name", "lon4", "lat4")
    at = F.array_position(F.array(F.lit("mall"), F.lit("gov"), F.lit("park"), F.lit("transit")), F.col("kind"))
    ranks = FIRST_RANKS
    while True:
        # the first ones of each kind are looked up; more of them where a kind has more and too few of the first lie inside
        first = kept(c.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= ranks), "first")
        held = pg.held_by_polygons(first, sides, of, CELL, "place_id").select("place_id").distinct()
        inside = kept(first.join(held, "place_id", "left_semi"), "inside")
        seen, found = (df.groupBy("kind").agg(F.count("*").alias("n")) for df in (first, inside))
        short = seen.withColumnRenamed("n", "seen").join(found, "kind", "left").filter((F.col("seen") >= ranks) & (F.coalesce("n", F.lit(0)) < 120))
        if not short.limit(1).count():
            break
        ranks *= 8
    out = inside.select("name", "kind", F.col("lon4").alias("lon"), F.col("lat4").alias("lat"), F.row_number().over(Window.partitionBy("kind").orderBy("rank")).alias("rn"))
    # no more than 120 of a kind can be taken
    return out.filter("rn <= 120").orderBy("rn", at).limit(120).select("name", "kind", "lon", "lat")


_BOX = "max(greatest(x1, x2)) >= 114.05 AND min(least(x1, x2)) <= 114.25 AND max(greatest(y1, y2)) >= 22.28 AND min(least(y1, y2)) <= 22.44"


@query("f37_ring_features", f"SELECT ring, count(*) AS vertices, round(abs(sum(x1 * y2 - x2 * y1)) / 2 * (0.9248 * 111320.0) * 110570.0, 0) AS area FROM {_EDGES} e WHERE ring % 10 <> 2 AND n >= 3 GROUP BY ring HAVING {_BOX} AND abs(sum(x1 * y2 - x2 * y1)) / 2 * (0.9248 * 111320.0) * 110570.0 >= 20000000")
def f37_rings(spark, d):
    """Outer rings of three vertices or more that meet a view box and have a least true area; the area is a sum over
    edges, so a ring is never gathered in a row."""
    e = kept(pg.edges(rings(spark, d).filter("not hole")), "edges")
    twice = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")))
    g = e.groupBy("ring").agg(
        F.count("*").alias("vertices"), (twice / 2 * (0.9248 * 111320.0) * 110570.0).alias("area"), F.min(F.least("x1", "x2")).alias("lo"), F.max(F.greatest("x1", "x2")).alias("hi"),
        F.min(F.least("y1", "y2")).alias("la"), F.max(F.greatest("y1", "y2")).alias("ha"),
    )
    return g.filter("hi >= 114.05 and lo <= 114.25 and ha >= 22.28 and la <= 22.44 and area >= 20000000").select("ring", "vertices", F.round("area", 0).alias("area"))


WIDTH, HEIGHT, SIGMA, STEP = 120, 74, 2.5, 0.005
_CELL = f"CAST(floor((lon - 113.85) / {STEP}) AS BIGINT) AS cx, CAST(floor((lat - 22.18) / {STEP}) AS BIGINT) AS cy"
_WEIGHTS = ", ".join(f"({k}, CAST({dn.kernel(SIGMA)[abs(k)]!r} AS DOUBLE))" for k in range(-10, 11))


def _pass(frame: str, axis: str, other: str, size: int) -> str:
    at = f"(({axis} + k) % {2 * size} + {2 * size}) % {2 * size}"
    return f"SELECT CASE WHEN {at} < {size} THEN {at} ELSE {2 * size - 1} - {at} END AS {axis}, {other}, sum(value * w) AS value FROM {frame}, k GROUP BY 1, 2"


@query("a26_urban_mask", f"""WITH k(k, w) AS (VALUES {_WEIGHTS}), c AS (SELECT DISTINCT cx, cy, 1.0::DOUBLE AS value FROM (SELECT {_CELL} FROM {PLACES} p WHERE seg <> 'MACHINERY') WHERE cx BETWEEN 0 AND {WIDTH - 1} AND cy BETWEEN 0 AND {HEIGHT - 1}),
 x AS ({_pass('c', 'cx', 'cy', WIDTH)}), y AS ({_pass('x', 'cy', 'cx', HEIGHT)}), g AS (SELECT a.range AS cx, b.range AS cy FROM range({WIDTH}) a, range({HEIGHT}) b WHERE b.range >= 12),
 v AS (SELECT g.cx, g.cy, coalesce(value, 0) AS value FROM g LEFT JOIN y ON y.cx = g.cx AND y.cy = g.cy), r AS (SELECT quantile_cont(value, 0.98) AS ref FROM v)
 SELECT cx, cy, round(least(1, value / ref), 6) AS density FROM v, r WHERE least(1, value / ref) > 0.18 AND NOT EXISTS (SELECT 1 FROM (SELECT {_CELL} FROM {ANCHORS} a) s WHERE s.cx = v.cx AND s.cy = v.cy)""")
def a26_mask(spark, d):
    """Built-up cells: places are smoothed over a grid whose southern strip is sea; cells of anchors are water."""
    cell = lambda df: df.select(F.floor((F.col("lon") - 113.85) / STEP).alias("cx"), F.floor((F.col("lat") - 22.18) / STEP).alias("cy"))
    out = dn.dense_cells(cell(places(spark, d).filter("seg <> 'MACHINERY'")), WIDTH, HEIGHT, SIGMA, F.col("cy") >= 12, cell(anchors(spark, d)))
    return out.select("cx", "cy", F.round("density", 6).alias("density"))
