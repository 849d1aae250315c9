"""Queries: events and their places by all tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import locate

from .base import query, read
from .zones import NAMED, named

_INDEX = f"(SELECT name AS place, min(place_id) AS place_id FROM {NAMED} n GROUP BY 1)"
_HEAD = "split_part(p.name, ' ', 1) || ' ' || split_part(p.name, ' ', 2)"
# an order tells of its customer's place: by name, in a text with another place, by district, or not at all
HAPPENED = f"""(SELECT o_orderkey AS event_id, o_orderkey % 97 AS chapter, CASE o_orderkey % 5 WHEN 0 THEN p.name ELSE 'event ' || o_orderkey END AS name,
 CASE o_orderkey % 5 WHEN 1 THEN 'seen at ' || p.name || ', then at ' || q.name || '.' WHEN 2 THEN 'somewhere in ' || {_HEAD} || '!' WHEN 3 THEN 'far off, in Nowhere No.' || o_orderkey % 4 ELSE 'no place at all' END AS claim
 FROM orders JOIN {NAMED} p ON p.place_id = o_custkey JOIN {NAMED} q ON q.place_id = o_custkey // 2)"""
_DISTRICTS = f"(SELECT district, row_number() OVER (ORDER BY district) AS rank FROM (SELECT DISTINCT {_HEAD} AS district FROM {NAMED} p WHERE name NOT LIKE 'gate%' UNION ALL SELECT 'Nowhere No.1') x)"


def happened(spark, d):
    p = named(spark, d).select("place_id", "name")
    q = p.withColumnsRenamed({"place_id": "second", "name": "other"})
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("place_id"), F.floor(F.col("o_custkey") / 2).alias("second")).join(p, "place_id").join(q, "second")
    k = F.col("o_orderkey") % 5
    claim = F.when(k == 1, F.concat(F.lit("seen at "), "name", F.lit(", then at "), "other", F.lit("."))).when(k == 2, F.concat(F.lit("somewhere in "), F.substring_index("name", " ", 2), F.lit("!")))
    claim = claim.when(k == 3, F.concat(F.lit("far off, in Nowhere No."), (F.col("o_orderkey") % 4).cast("string"))).otherwise("no place at all")
    name = F.when(k == 0, F.col("name")).otherwise(F.concat(F.lit("event "), F.col("o_orderkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 97).alias("chapter"), name.alias("name"), claim.alias("claim"))


def _bare(text: str) -> str:
    return f"regexp_replace({text}, '[ .,_#·-]', '', 'g')"


def _district(col: str) -> str:
    return f"(SELECT t.{col} AS k, arg_max(district, {{'e': t.n = d.n, 'l': length(d.n), 'r': -rank}}) AS district FROM (SELECT DISTINCT {col}, {_bare(col)} AS n FROM u) t JOIN (SELECT *, {_bare('district')} AS n FROM {_DISTRICTS} z) d ON t.n <> '' AND (contains(t.n, d.n) OR contains(d.n, t.n)) GROUP BY 1)"


@query("j4_all_tiers", f"""WITH e AS MATERIALIZED (SELECT * FROM {HAPPENED} h), i AS MATERIALIZED (SELECT * FROM {_INDEX} x), h AS MATERIALIZED (SELECT event_id, chapter, place, place_id FROM e JOIN i ON contains(name || ' ' || claim, place)),
 t1 AS (SELECT event_id, 1 AS tier, place, place_id FROM e JOIN i ON place = name), t2 AS (SELECT event_id, 2 AS tier, place, place_id FROM h QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY length(place) DESC, place_id) = 1),
 u AS MATERIALIZED (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM t1 UNION ALL SELECT event_id FROM t2)),
 n AS (SELECT event_id, coalesce(a.district, b.district) AS district FROM u LEFT JOIN {_district('name')} a ON a.k = name LEFT JOIN {_district('claim')} b ON b.k = claim),
 s AS (SELECT district, arg_min(place, place_id) AS place, min(place_id) AS place_id FROM (SELECT DISTINCT district FROM n WHERE district IS NOT NULL) x JOIN i ON contains(place, district) GROUP BY 1),
 t3 AS (SELECT event_id, 3 AS tier, coalesce(place, n.district) AS place, place_id FROM n LEFT JOIN s ON s.district = n.district WHERE n.district IS NOT NULL),
 f AS (SELECT event_id, chapter, arg_min(place, place_id) AS place, min(place_id) AS place_id FROM h GROUP BY 1, 2), m AS (SELECT chapter, place, place_id FROM (SELECT chapter, place, place_id, count(*) AS c, min(event_id) AS first FROM f GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY c DESC, first) = 1),
 t4 AS (SELECT event_id, 4 AS tier, place, place_id FROM u JOIN m USING (chapter)), x AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4 UNION ALL SELECT event_id, 5, NULL, NULL FROM e)
 SELECT event_id, tier, place, place_id FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier) = 1""")
def j4_all(spark, d):
    index = named(spark, d).groupBy(F.col("name").alias("place")).agg(F.min("place_id").alias("place_id"))
    g = named(spark, d).filter("name not like 'gate%'").select(F.substring_index("name", " ", 2).alias("district")).distinct()
    g = g.union(spark.createDataFrame([("Nowhere No.1",)], "district string"))
    from placeweave.operators.numbering import numbered

    return locate.match_events(happened(spark, d), index, numbered(g, ["district"], name="rank"))
