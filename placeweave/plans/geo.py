"""Queries: points, boxes, polygons, grids, routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import match as mt

from .base import ANCHORS, PLACES, anchors, metres, places, query, sql_metres

DEG_LON, DEG_LAT = 1000 / (0.9248 * 111320.0), 1000 / 110570.0
TIERS = "(VALUES ('overview', 113.85, 114.45, 22.18, 22.55, 0.6), ('region', 113.95, 114.35, 22.22, 22.50, 0.4), ('district', 114.05, 114.25, 22.28, 22.44, 0.2), ('street', 114.12, 114.18, 22.30, 22.36, 0.06)) t(tier, lo, hi, la, ha, span)"
ROWS = [("overview", 113.85, 114.45, 22.18, 22.55, 0.6), ("region", 113.95, 114.35, 22.22, 22.50, 0.4), ("district", 114.05, 114.25, 22.28, 22.44, 0.2), ("street", 114.12, 114.18, 22.30, 22.36, 0.06)]


def tiers(spark):
    return F.broadcast(spark.createDataFrame(ROWS, "tier string, lo double, hi double, la double, ha double, span double"))


@query("j19_near_pairs", f"SELECT a.place_id AS a, b.anchor_id AS b, round({sql_metres('a', 'b')}, 3) AS m FROM {PLACES} a JOIN {ANCHORS} b ON {sql_metres('a', 'b')} <= 1000")
def j19(spark, d):
    b = anchors(spark, d).select(F.col("anchor_id").alias("b"), "lon", "lat")
    x = mt.within(places(spark, d).select(F.col("place_id").alias("a"), "lon", "lat"), b, 1000, metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), DEG_LON, DEG_LAT)
    return x.select("a", "b", F.round("dist", 3).alias("m"))


RING = [(114.0, 22.25), (114.2, 22.22), (114.35, 22.35), (114.2, 22.48), (114.15, 22.35), (113.95, 22.45)]
EDGE_SQL = ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(RING, RING[1:] + RING[:1])))


@query("j15_point_in_polygon", f"WITH e(i, x1, y1, x2, y2) AS (VALUES {EDGE_SQL}) SELECT place_id FROM {PLACES} p, e WHERE lon BETWEEN 113.95 AND 114.35 AND lat BETWEEN 22.22 AND 22.48 GROUP BY place_id HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1")
def j15(spark, d):
    p = places(spark, d).filter("lon between 113.95 and 114.35 and lat between 22.22 and 22.48").select("place_id", "lon", "lat")
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]):
        hit = ((F.lit(y1) > F.col("lat")) != (F.lit(y2) > F.col("lat"))) & (F.col("lon") < (x2 - x1) * (F.col("lat") - y1) / (y2 - y1) + x1)
        crossings = crossings + F.when(hit, 1).otherwise(0)
    return p.filter(crossings % 2 == 1).select("place_id")


VIEW = f"(SELECT place_id, lon - 0.02 * (1 + nation % 4) AS vlo, lon + 0.02 * (1 + nation % 4) AS vhi, lat - 0.01 AS vla, lat + 0.01 AS vha FROM {PLACES} p)"


def views(spark, d):
    w = 0.02 * (1 + F.col("nation") % 4)
    return places(spark, d).select("place_id", (F.col("lon") - w).alias("vlo"), (F.col("lon") + w).alias("vhi"), (F.col("lat") - 0.01).alias("vla"), (F.col("lat") + 0.01).alias("vha"))


COVERS = "lo <= vlo AND hi >= vhi AND la <= vla AND ha >= vha"


@query("j16_narrowest_tier", f"SELECT place_id, coalesce(arg_min(tier, span) FILTER ({COVERS}), 'street') AS tier FROM {VIEW} v, {TIERS} GROUP BY place_id")
def j16(spark, d):
    x = views(spark, d).join(tiers(spark), F.expr(COVERS), "left")
    return x.groupBy("place_id").agg(F.coalesce(F.min_by("tier", "span"), F.lit("street")).alias("tier"))


@query("j17_next_finer_tier", f"SELECT place_id, arg_max(tier, span) AS tier FROM {VIEW} v JOIN {TIERS} ON {COVERS} AND span < 0.5 GROUP BY place_id")
def j17(spark, d):
    return views(spark, d).join(tiers(spark), F.expr(COVERS + " and span < 0.5")).groupBy("place_id").agg(F.max_by("tier", "span").alias("tier"))


@query("j18_box_intersections", f"SELECT tier, count(*) AS n FROM {VIEW} v JOIN {TIERS} ON vlo <= hi AND vhi >= lo AND vla <= ha AND vha >= la GROUP BY tier")
def j18(spark, d):
    return views(spark, d).join(tiers(spark), F.expr("vlo <= hi and vhi >= lo and vla <= ha and vha >= la")).groupBy("tier").agg(F.count("*").alias("n"))


@query("j35_lod_thresholds", f"SELECT place_id, coalesce((SELECT arg_min(tier, span) FROM {TIERS} WHERE span >= v.vhi - v.vlo), 'street') AS lod FROM {VIEW} v")
def j35(spark, d):
    x = views(spark, d).join(tiers(spark), F.expr("span >= vhi - vlo"), "left")
    return x.groupBy("place_id").agg(F.coalesce(F.min_by("tier", "span"), F.lit("street")).alias("lod"))


@query("a26_density_grid", f"WITH c AS (SELECT CAST(floor((lon - 113.85) / 0.02) AS BIGINT) AS x, CAST(floor((lat - 22.18) / 0.02) AS BIGINT) AS y, count(*) AS n FROM {PLACES} p GROUP BY 1, 2) SELECT c.x, c.y, CAST(sum(b.n) AS BIGINT) AS smooth FROM c JOIN c b ON abs(b.x - c.x) <= 1 AND abs(b.y - c.y) <= 1 GROUP BY c.x, c.y")
def a26(spark, d):
    c = places(spark, d).groupBy(F.floor((F.col("lon") - 113.85) / 0.02).alias("x"), F.floor((F.col("lat") - 22.18) / 0.02).alias("y")).agg(F.count("*").alias("n"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = c.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "n")
    return spread.groupBy("x", "y").agg(F.sum("n").alias("smooth")).join(c.select("x", "y"), ["x", "y"], "left_semi")


@query("a27_marker_grid", f"SELECT CAST(floor(lon * 50) AS BIGINT) AS gx, CAST(floor(lat * 50) AS BIGINT) AS gy, count(*) AS n, bool_or(score > 9000) AS any_active, bool_or(seg = 'BUILDING') AS any_real FROM {PLACES} p GROUP BY 1, 2")
def a27(spark, d):
    return places(spark, d).groupBy(F.floor(F.col("lon") * 50).alias("gx"), F.floor(F.col("lat") * 50).alias("gy")).agg(F.count("*").alias("n"), F.bool_or(F.col("score") > 9000).alias("any_active"), F.bool_or(F.col("seg") == "BUILDING").alias("any_real"))


@query("a28_chapter_boxes", f"SELECT nation AS chapter, round(min(lon) - greatest(0.02, max(lon) - min(lon)) * 0.25, 6) AS lo, round(max(lon) + greatest(0.02, max(lon) - min(lon)) * 0.25, 6) AS hi FROM {PLACES} p GROUP BY nation")
def a28(spark, d):
    pad = F.greatest(F.lit(0.02), F.max("lon") - F.min("lon")) * 0.25
    return places(spark, d).groupBy(F.col("nation").alias("chapter")).agg(F.round(F.min("lon") - pad, 6).alias("lo"), F.round(F.max("lon") + pad, 6).alias("hi"))


LEAD = f"(SELECT route, m, real FROM (SELECT nation AS route, sqrt(pow((lon - lead(lon) OVER w) * (0.9248 * 111320.0), 2) + pow((lat - lead(lat) OVER w) * 110570.0, 2)) AS m, score > 0 AND lead(score) OVER w > 0 AS real FROM {PLACES} p WINDOW w AS (PARTITION BY nation ORDER BY place_id)) WHERE m IS NOT NULL)"


def steps(spark, d):
    w = Window.partitionBy("nation").orderBy("place_id")
    x = places(spark, d).withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.lead("lat").over(w)).withColumn("s2", F.lead("score").over(w)).filter("lon2 is not null")
    return x.select(F.col("nation").alias("route"), metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("m"), ((F.col("score") > 0) & (F.col("s2") > 0)).alias("real"))


@query("a29_segment_quality", f"SELECT route, count(*) FILTER (real) AS real_steps, round(median(m) FILTER (real), 3) AS median_m, round(max(m), 3) AS max_m FROM {LEAD} l GROUP BY route")
def a29(spark, d):
    return steps(spark, d).groupBy("route").agg(F.count_if("real").alias("real_steps"), F.round(F.percentile(F.when(F.col("real"), F.col("m")), 0.5), 3).alias("median_m"), F.round(F.max("m"), 3).alias("max_m"))


@query("a30_path_lengths", f"SELECT route, round(sum(m), 2) AS metres FROM {LEAD} l GROUP BY route")
def a30(spark, d):
    return steps(spark, d).groupBy("route").agg(F.round(F.sum("m"), 2).alias("metres"))


@query("a32_wild_places", f"SELECT p.place_id FROM {PLACES} p WHERE NOT EXISTS (SELECT 1 FROM {ANCHORS} a WHERE {sql_metres('p', 'a')} <= 1000)")
def a32(spark, d):
    p = places(spark, d).select("place_id", "lon", "lat")
    near = mt.within(p, anchors(spark, d).select("lon", "lat"), 1000, metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), DEG_LON, DEG_LAT)
    return p.select("place_id").join(near.select("place_id").distinct(), "place_id", "left_anti")


@query("f37_feature_filter", f"SELECT place_id FROM {PLACES} p WHERE seg = 'BUILDING' AND lon BETWEEN 114.0 AND 114.3 AND score * score > 1000000")
def f37(spark, d):
    tags = F.create_map(F.lit("seg"), "seg")
    return places(spark, d).withColumn("tags", tags).filter((F.element_at("tags", F.lit("seg")) == "BUILDING") & F.col("lon").between(114.0, 114.3) & (F.col("score") * F.col("score") > 1000000)).select("place_id")


@query("w10_label_collisions", f"SELECT place_id FROM {PLACES} p QUALIFY row_number() OVER (PARTITION BY floor(lon * 100), floor(lat * 100) ORDER BY nation, name) = 1")
def w10(spark, d):
    return mt.best(places(spark, d).withColumn("x", F.floor(F.col("lon") * 100)).withColumn("y", F.floor(F.col("lat") * 100)), ["x", "y"], [F.col("nation"), F.col("name")]).select("place_id")


# all pairs in order of their distance, each taken if both ends are free
_PAIRED = f"(SELECT a.anchor_id AS a, b.anchor_id AS b, row_number() OVER (ORDER BY {sql_metres('a', 'b')}, a.anchor_id, b.anchor_id) AS rn FROM {ANCHORS} a JOIN {ANCHORS} b ON a.anchor_id < b.anchor_id AND {sql_metres('a', 'b')} <= 3000)"


@query("g7_nearest_pairing", f"WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {_PAIRED} x), w(rn, a, b, used, won) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), false UNION ALL SELECT p.rn, p.a, p.b, CASE WHEN list_has_any(used, [p.a, p.b]) THEN used ELSE list_concat(used, [p.a, p.b]) END, NOT list_has_any(used, [p.a, p.b]) FROM w JOIN p ON p.rn = w.rn + 1) SELECT a, b FROM w WHERE won")
def g7(spark, d):
    """Open ends paired in rounds of mutual nearest neighbours within a radius, each used once."""
    from placeweave.operators.graph import kept

    a = anchors(spark, d).select(F.col("anchor_id").alias("a"), "lon", "lat")
    pairs = mt.within(a, a.withColumnRenamed("a", "b"), 3000, metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3 * DEG_LON, 3 * DEG_LAT).filter("a <> b").select("a", "b", "dist")
    open_pairs, out = kept(pairs, "pairs"), None
    while open_pairs.limit(1).count():
        near = open_pairs.groupBy("a").agg(F.min_by("b", F.struct("dist", "b")).alias("b"))
        back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
        won = kept(near.join(back, ["a", "b"]), "won")
        out = won if out is None else out.union(won)
        used = won.select("a").distinct()
        open_pairs = kept(open_pairs.join(used, "a", "left_anti").join(used.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b", "dist"), "pairs")
    return (out if out is not None else pairs.select("a", "b")).filter("a < b").select("a", "b")
