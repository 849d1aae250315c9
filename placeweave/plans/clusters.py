"""Queries: chapter clusters, prefix clusters, sets of characters, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import numbering as nb
from placeweave.operators import similarity as sim
from placeweave.operators import spread as sp
from placeweave.operators.graph import kept

from .base import PLACES, metres, places, query, read, sql_metres
from .zones import NAMED, named

SCALE = (0.9248 * 111320.0, 110570.0)

# A place's chapters: the block of about 700 m that it stands in, for some also the next one to the east. One in four is
# known exactly, one approximately, one by district, one not at all.
_CH = "CAST(floor(lon * 150) AS BIGINT) * 10000 + CAST(floor(lat * 150) AS BIGINT)"
SCENES = f"(SELECT place_id, lon, lat, place_id % 4 AS precision, CASE WHEN place_id % 7 = 0 THEN [{_CH}, {_CH} + 10000] ELSE [{_CH}] END AS chapters FROM {PLACES} p)"


def scenes(spark, d):
    ch = F.floor(F.col("lon") * 150) * 10000 + F.floor(F.col("lat") * 150)
    return places(spark, d).select("place_id", "lon", "lat", (F.col("place_id") % 4).alias("precision"), F.when(F.col("place_id") % 7 == 0, F.array(ch, ch + 10000)).otherwise(F.array(ch)).alias("chapters"))


@query("e11_cluster_inference", f"""WITH s AS (SELECT * FROM {SCENES} q), a AS (SELECT DISTINCT lon, lat, unnest(chapters) AS ch FROM s WHERE precision <= 1), c AS (SELECT place_id, unnest(chapters) AS ch FROM s WHERE precision = 3),
 m AS (SELECT DISTINCT place_id, lon, lat FROM c JOIN a USING (ch)), d AS (SELECT a.place_id, max({sql_metres('a', 'b')}) AS spread FROM m a JOIN m b USING (place_id) GROUP BY 1)
 SELECT place_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS anchors, round(any_value(spread), 2) AS spread, round(0.72 - 0.17 * any_value(spread) / 500, 2) AS conf FROM m JOIN d USING (place_id) GROUP BY place_id HAVING count(*) >= 2 AND any_value(spread) <= 500""")
def e11_inference(spark, d):
    """Unknown places whose chapters' well-known places stand close together take their centre."""
    s = scenes(spark, d)
    anchors = s.filter("precision <= 1").select(F.explode("chapters").alias("chapter"), "lon", "lat")
    out = sp.chapter_clusters(s.filter("precision = 3").select(F.col("place_id").alias("id"), "chapters"), anchors, SCALE)
    return out.select(F.col("id").alias("place_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "anchors", F.round("spread", 2).alias("spread"), F.round("conf", 2).alias("conf"))


_STEM = "split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2)"


@query("e21_prefix_clusters", f"""WITH g AS (SELECT * FROM {NAMED} q), s AS (SELECT DISTINCT {_STEM} AS stem FROM g WHERE name NOT LIKE 'gate%'), m AS (SELECT DISTINCT stem, round(lon, 6) AS lon, round(lat, 6) AS lat FROM s JOIN g ON starts_with(name, stem) AND length(name) > length(stem)),
 n AS (SELECT a.stem, a.lon AS lon_a, a.lat AS lat_a, count(*) AS n, avg(b.lon) AS lon, avg(b.lat) AS lat FROM m a JOIN m b USING (stem) WHERE {sql_metres('a', 'b')} <= 1000 GROUP BY ALL HAVING count(*) >= 2),
 t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, lon_a, lat_a) = 1) SELECT stem, n, round(lon, 6) AS lon, round(lat, 6) AS lat FROM t WHERE lon BETWEEN 113.9 AND 114.4 AND lat BETWEEN 22.2 AND 22.5""")
def e21_clusters(spark, d):
    """The largest cluster of places whose longer names start with a stem; ties go to the westernmost, southernmost one."""
    g = named(spark, d).select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    stems = g.filter("name not like 'gate%'").select(F.substring_index("name", " ", 2).alias("stem")).distinct()
    m = sp.prefix_members(stems, g, "stem", "name").select("stem", "lon", "lat").distinct()
    # an id that orders a stem's points by place
    m = kept(m.withColumn("id", F.round((F.col("lon") + 180) * 1e6).cast("long") * 200_000_000 + F.round((F.col("lat") + 90) * 1e6).cast("long")), "members")
    out = sp.largest_balls(m, "stem", 1000, metres, SCALE)
    # means of rounded places often end in half a unit: they are rounded as SQL rounds them, by the product
    rounded = lambda c: (F.round(F.col(c) * 1e6) / 1e6).alias(c)
    return out.filter("lon between 113.9 and 114.4 and lat between 22.2 and 22.5").select("stem", "n", rounded("lon"), rounded("lat"))


_LABELS = "(SELECT min(p_partkey) AS id, p_name || ' ' || p_brand AS name FROM part GROUP BY 2)"


@query("f18_similar_names", f"WITH w AS (SELECT id, list_distinct(string_split(name, '')) AS s FROM {_LABELS} l) SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS shared, CAST(len(list_distinct(list_concat(a.s, b.s))) AS INTEGER) AS total FROM w a JOIN w b ON a.id < b.id WHERE 100 * len(list_intersect(a.s, b.s)) >= 95 * len(list_distinct(list_concat(a.s, b.s)))")
def f18_similar(spark, d):
    """Names whose sets of characters have a Jaccard similarity of 0.95 or more."""
    w = read(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("id"))
    return sim.similar_sets(w.select("id", F.split("name", "").alias("items")), 95)


# people: part names in several spellings; brands are their aliases, sizes their chapters
_SPELT = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' (' || p_container || ')' WHEN 2 THEN replace(p_name, ' ', '.') WHEN 3 THEN substr(p_name, 2) WHEN 4 THEN p_name || 's' ELSE replace(p_name, 'o', 'a') END".replace("p_container", "p_type")
_PEOPLE = f"(SELECT min(p_partkey) AS id, {_SPELT} AS name, list(DISTINCT p_brand || CASE WHEN p_size < 4 THEN '.' ELSE ' of ' || CAST(p_partkey AS VARCHAR) END) AS aliases, list(DISTINCT p_size) AS chapters FROM part GROUP BY 2)"
_NORM = "lower(regexp_replace(regexp_replace({}, '[(][^)]*[)]', '', 'g'), '[ .·]', '', 'g'))"
_AT = "coalesce(list_filter(range(1, CAST(least(length(p), length(q)) AS BIGINT) + 1), lambda i: substr(p, i, 1) <> substr(q, i, 1))[1], least(length(p), length(q)) + 1)"
_SHORTEST = "list_sort(list_transform(names, lambda n: {'l': length(n), 'n': n}))[1].n"


@query("e14_variant_rules", f"""WITH e AS (SELECT *, {_NORM.format('name')} AS norm FROM {_PEOPLE} p), g AS (SELECT 'norm' AS pattern, list_sort(list(DISTINCT id)) AS ids, list_sort(list(DISTINCT name)) AS names, 0.8 AS conf FROM e GROUP BY norm HAVING count(DISTINCT name) > 1),
 a AS (SELECT 'alias' AS pattern, list_sort(list(DISTINCT id)) AS ids, list_sort(list(DISTINCT name)) AS names, 0.6 AS conf FROM (SELECT id, name, {_NORM.format('al')} AS al FROM (SELECT id, name, unnest(aliases) AS al FROM e)) GROUP BY al HAVING count(DISTINCT id) > 1),
 f AS (SELECT DISTINCT norm AS p FROM e WHERE length(norm) >= 3), n AS (SELECT x.p, y.p AS q FROM f x JOIN f y ON x.p < y.p AND levenshtein(x.p, y.p) = 1),
 d AS (SELECT p, q, CASE WHEN length(q) <= length(p) THEN substr(p, {_AT}, 1) ELSE '' END AS x, CASE WHEN length(q) >= length(p) THEN substr(q, {_AT}, 1) ELSE '' END AS y FROM n),
 c AS (SELECT p, q, CASE WHEN x = 's' OR y = 's' THEN 0.8 WHEN length(p) <> length(q) THEN 0.6 ELSE 0.5 END AS conf FROM d WHERE NOT ((x = 'l' AND y = 'r') OR (x = 'r' AND y = 'l'))),
 t AS (SELECT 'typo' AS pattern, list_sort([v.id, w.id]) AS ids, list_sort([v.name, w.name]) AS names, CASE WHEN len(list_intersect(v.chapters, w.chapters)) > 0 THEN c.conf ELSE least(0.45, c.conf) END AS conf FROM c JOIN e v ON v.norm = c.p JOIN e w ON w.norm = c.q)
 SELECT pattern, ids, names, {_SHORTEST} AS prototype, conf::DOUBLE AS conf FROM (SELECT * FROM g UNION ALL SELECT * FROM t) UNION ALL SELECT pattern, ids, names, names[1], conf::DOUBLE FROM a""")
def e14_rules(spark, d):
    k = F.col("p_partkey") % 6
    name = F.col("p_name")
    spelt = F.when(k == 0, name).when(k == 1, F.concat(F.upper(name), F.lit(" ("), "p_type", F.lit(")"))).when(k == 2, F.replace(name, F.lit(" "), F.lit("."))).when(k == 3, F.substring(name, 2, 1000)).when(k == 4, F.concat(name, F.lit("s"))).otherwise(F.replace(name, F.lit("o"), F.lit("a")))
    alias = F.concat("p_brand", F.when(F.col("p_size") < 4, ".").otherwise(F.concat(F.lit(" of "), F.col("p_partkey").cast("string"))))
    people = read(spark, d, "part").groupBy(spelt.alias("name")).agg(F.min("p_partkey").alias("id"), F.collect_set(alias).alias("aliases"), F.collect_set("p_size").alias("chapters"))
    contrasts, particles = spark.createDataFrame([("l", "r")], "x string, y string"), spark.createDataFrame([("s",)], "letter string")
    return sim.variant_proposals(people, contrasts, particles)


@query("w2_order_numbers", "SELECT o_orderkey, 'ev_' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 9, '0') AS id FROM orders")
def w2_orders(spark, d):
    """Consecutive ids in the order of date and key over all rows."""
    o = nb.numbered(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return o.select("o_orderkey", F.concat(F.lit("ev_"), F.lpad(F.col("number").cast("string"), 9, "0")).alias("id"))
