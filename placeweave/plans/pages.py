"""Queries: the viewer's pages as rows, what depends on moved places, bands of chapters, tiered lookups, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import match as mt
from placeweave.operators import spread as sp
from placeweave.operators.graph import kept
from placeweave.operators.numbering import numbered

from .base import ANCHORS, PLACES, STORY, anchors, metres, places, query, read, story
from .zones import NAMED, SHAPES, named, shapes

SCALE = (0.9248 * 111320.0, 110570.0)


def first_k(df, by: list[str], order: list, k: int):
    """The first k rows of each group, numbered from 1; tasks only hand on their own first k."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("pos") <= k)


@query("v2_chapter_rows", f"""WITH s AS (SELECT * FROM {STORY} x), e AS (SELECT chapter, 'event' AS section, row_number() OVER (PARTITION BY chapter ORDER BY event_id) AS pos, event_id AS id, title AS label FROM s),
 n AS (SELECT person, count(DISTINCT chapter) AS chapters FROM s GROUP BY 1), p AS (SELECT chapter, 'person' AS section, row_number() OVER (PARTITION BY chapter ORDER BY chapters DESC, person) AS pos, person AS id, CAST(chapters AS VARCHAR) AS label FROM (SELECT DISTINCT chapter, person FROM s) JOIN n USING (person)),
 q AS (SELECT chapter, k, max(conf) AS conf FROM s WHERE conf >= 0.6 AND k IS NOT NULL GROUP BY 1, 2), l AS (SELECT chapter, 'place' AS section, row_number() OVER (PARTITION BY chapter ORDER BY conf DESC, k) AS pos, k AS id, CAST(CAST(floor(conf * 100 + 0.5) AS INTEGER) AS VARCHAR) || '%' AS label FROM q),
 m AS (SELECT chapter, 'more' AS section, 1 AS pos, count(*) - 20 AS id, 'events' AS label FROM s GROUP BY 1 HAVING count(*) > 20)
 SELECT * FROM e WHERE pos <= 20 UNION ALL SELECT * FROM p WHERE pos <= 12 UNION ALL SELECT * FROM l WHERE pos <= 5 UNION ALL SELECT * FROM m""")
def v2_rows(spark, d):
    """Each chapter's page: its first 20 events and how many more, the 12 people of most chapters, the five surest places."""
    s = story(spark, d)
    out = lambda df, section, key, label: df.select("chapter", F.lit(section).alias("section"), F.col("pos").cast("long").alias("pos"), F.col(key).cast("long").alias("id"), label.alias("label"))
    events = out(first_k(s, ["chapter"], [F.col("event_id")], 20), "event", "event_id", F.col("title"))
    total = s.groupBy("person").agg(F.count_distinct("chapter").alias("chapters"))
    active = mt.salted(s.select("chapter", "person").distinct(), total, ["person"], F.col("chapter"))
    people = out(first_k(active, ["chapter"], [F.desc("chapters"), F.col("person")], 12), "person", "person", F.col("chapters").cast("string"))
    sure = s.filter("conf >= 0.6 and k is not null").groupBy("chapter", "k").agg(F.max("conf").alias("conf"))
    spots = out(first_k(sure, ["chapter"], [F.desc("conf"), F.col("k")], 5), "place", "k", F.concat(F.floor(F.col("conf") * 100 + 0.5).cast("int").cast("string"), F.lit("%")))
    more = s.groupBy("chapter").agg((F.count("*") - 20).alias("n")).filter("n > 0").withColumn("pos", F.lit(1))
    return events.union(people).union(spots).union(out(more, "more", "n", F.lit("events")))


@query("v3_place_rows", f"""WITH o AS (SELECT o_custkey AS place_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
 SELECT place_id, 'detail' AS section, 0 AS pos, place_id AS id, name || ' (' || CASE WHEN fictional THEN 'fictional' ELSE 'known' END || ')' AS label FROM {NAMED} n UNION ALL SELECT place_id, 'event', pos, o_orderkey, o_orderpriority FROM o WHERE pos <= 20""")
def v3_rows(spark, d):
    """Each place's page: the place, then its first 20 events."""
    detail = named(spark, d).select("place_id", F.lit("detail").alias("section"), F.lit(0).cast("long").alias("pos"), F.col("place_id").alias("id"), F.concat("name", F.lit(" ("), F.when(F.col("fictional"), "fictional").otherwise("known"), F.lit(")")).alias("label"))
    o = first_k(read(spark, d, "orders").select(F.col("o_custkey").alias("place_id"), "o_orderkey", "o_orderpriority"), ["place_id"], [F.col("o_orderkey")], 20)
    return detail.union(o.select("place_id", F.lit("event"), F.col("pos").cast("long"), "o_orderkey", "o_orderpriority"))


@query("v4_event_rows", f"SELECT o_orderkey AS event_id, CAST(month(o_orderdate) AS INTEGER) AS chapter, o_orderpriority AS title, p.name AS place, CASE WHEN p.place_id IS NULL THEN 'unknown' WHEN fictional THEN 'fictional' ELSE 'known' END AS precision FROM orders LEFT JOIN {NAMED} p ON p.place_id = o_custkey")
def v4_rows(spark, d):
    """Each event's page with its place."""
    p = named(spark, d).select(F.col("place_id").alias("o_custkey"), "name", "fictional")
    x = mt.salted(read(spark, d, "orders"), p, ["o_custkey"], F.col("o_orderkey"), "left")
    return x.select(F.col("o_orderkey").alias("event_id"), F.month("o_orderdate").alias("chapter"), F.col("o_orderpriority").alias("title"), F.col("name").alias("place"), F.when(F.col("name").isNull(), "unknown").when(F.col("fictional"), "fictional").otherwise("known").alias("precision"))


# entries of a chronicle: a customer, the months of its orders with the roles it has there, its period and where that is from
_ENTRIES = "(SELECT o_custkey AS entry, min(month(o_orderdate)) AS first_mention, bool_or(month(o_orderdate) = 3) AS here, arg_min(o_orderpriority, o_orderkey) AS label, arg_min(o_orderstatus, o_orderkey) AS src FROM orders GROUP BY 1)"


@query("v5_v6_chapter_entries", f"SELECT CAST(row_number() OVER (ORDER BY CASE WHEN src IN ('F', 'O') THEN label ELSE '9' END, first_mention, entry) AS BIGINT) AS pos, entry, CASE WHEN src IN ('F', 'O') THEN label END AS period, CAST(first_mention AS INTEGER) AS first_mention FROM {_ENTRIES} e WHERE here")
def v5_rows(spark, d):
    """Entries that occur in a chapter in any role, by period (only where it comes from a model or a boundary; unknown last), first
    mention and name."""
    o = read(spark, d, "orders").withColumn("m", F.month("o_orderdate"))
    e = o.groupBy(F.col("o_custkey").alias("entry")).agg(F.min("m").alias("first_mention"), F.bool_or(F.col("m") == 3).alias("here"), F.min_by("o_orderpriority", "o_orderkey").alias("label"), F.min_by("o_orderstatus", "o_orderkey").alias("src")).filter("here")
    e = e.withColumn("period", F.when(F.col("src").isin("F", "O"), F.col("label"))).withColumn("rank", F.coalesce("period", F.lit("9")))
    return numbered(e.select("entry", "period", "first_mention", "rank"), ["rank", "first_mention", "entry"], name="pos").select("pos", "entry", "period", "first_mention")


_BANDS = f"""WITH c AS (SELECT DISTINCT CAST(o_orderkey % 200 AS BIGINT) AS cur FROM orders), z AS (SELECT zone, chapters FROM {SHAPES} s), n AS (SELECT place_id, chapters FROM {NAMED} q WHERE NOT fictional),
 e AS (SELECT o_orderkey % 200 AS ch, count(*) AS n FROM orders GROUP BY 1)"""


@query("j20_bands", _BANDS + """ SELECT cur, coalesce((SELECT sum(n) FROM e WHERE abs(ch - cur) <= 1), 0)::BIGINT AS events, (SELECT count(*) FROM n WHERE len(list_filter(chapters, lambda x: abs(x - cur) <= 3)) > 0) AS places,
 coalesce((SELECT sum(n) FROM e WHERE abs(ch - cur) <= 2), 0)::BIGINT AS viewport, (SELECT count(*) FROM z WHERE len(chapters) = 0 OR len(list_filter(chapters, lambda x: x <= cur AND cur <= x + 12)) > 0) AS zones FROM c""")
def j20_bands(spark, d):
    """What each chapter shows: events one chapter and viewport two chapters around it, places three, zones up to twelve behind."""
    per = read(spark, d, "orders").groupBy((F.col("o_orderkey") % 200).alias("ch")).agg(F.count("*").alias("n"))
    cur = per.select(F.col("ch").alias("cur"))
    around = lambda a, b: F.explode(F.sequence(F.col("cur") + a, F.col("cur") + b))
    both = cur.withColumn("ch", around(-2, 2)).join(per, "ch").groupBy("cur").agg(F.sum(F.when(F.abs(F.col("ch") - F.col("cur")) <= 1, F.col("n")).otherwise(0)).alias("events"), F.sum("n").alias("viewport"))

    def seen(df, key, before, behind):
        """Items of each chapter: a chapter of an item is widened, and an item counts once."""
        wide = df.select(key, F.explode("chapters").alias("x")).select(key, F.explode(F.sequence(F.col("x") - before, F.col("x") + behind)).alias("cur")).distinct()
        return wide.groupBy("cur").agg(F.count("*").alias("n"))

    spots = seen(named(spark, d).filter("not fictional"), "place_id", 3, 3).withColumnRenamed("n", "places")
    z = shapes(spark, d)[2].select("zone", "chapters")
    always = z.agg(F.count_if(F.size("chapters") == 0).alias("always"))
    active = seen(z, "zone", 0, 12).withColumnRenamed("n", "zones")
    out = cur.join(both, "cur", "left").join(spots, "cur", "left").join(active, "cur", "left").join(F.broadcast(always))  # one row
    return out.select("cur", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("viewport", F.lit(0)).alias("viewport"), (F.coalesce("zones", F.lit(0)) + F.col("always")).alias("zones"))


_STEM = "split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2)"
_CLUSTERS = f"""(WITH g AS (SELECT * FROM {NAMED} q), s AS (SELECT DISTINCT {_STEM} AS stem FROM g WHERE name NOT LIKE 'gate%'), m AS (SELECT DISTINCT stem, round(lon, 6) AS lon, round(lat, 6) AS lat FROM s JOIN g ON starts_with(name, stem) AND length(name) > length(stem)),
 n AS (SELECT a.stem, a.lon AS lon_a, a.lat AS lat_a, count(*) AS n, avg(b.lon) AS lon, avg(b.lat) AS lat FROM m a JOIN m b USING (stem) WHERE sqrt(pow((a.lon - b.lon) * (0.9248 * 111320.0), 2) + pow((a.lat - b.lat) * 110570.0, 2)) <= 1000 GROUP BY ALL HAVING count(*) >= 2)
 SELECT stem, lon, lat FROM n QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, lon_a, lat_a) = 1)"""
_BOX = "lon BETWEEN 113.95 AND 114.35 AND lat BETWEEN 22.2 AND 22.5"


@query("j14_all_tiers", f"""WITH a AS (SELECT DISTINCT {_STEM} AS proto FROM {NAMED} q WHERE name NOT LIKE 'gate%'), w AS (SELECT a.proto || CASE WHEN hash_k = 0 THEN ' ring' ELSE '' END AS proto, a.proto AS stem FROM (SELECT proto, length(proto) % 2 AS hash_k FROM a) a),
 o AS (SELECT name, arg_min(lon, place_id) AS lon, arg_min(lat, place_id) AS lat FROM {NAMED} q GROUP BY 1), t1 AS (SELECT proto, 1 AS tier, lon, lat FROM w JOIN o ON name = proto WHERE {_BOX}), t2 AS (SELECT proto, 2 AS tier, lon, lat FROM w JOIN {_CLUSTERS} c ON c.stem = proto WHERE {_BOX}),
 t3 AS (SELECT proto, 3 AS tier, lon, lat FROM w JOIN {ANCHORS} x ON x.nation = CAST(split_part(stem, ' ', 2) AS INTEGER) QUALIFY row_number() OVER (PARTITION BY proto ORDER BY anchor_id) = 1 AND starts_with(stem, 'old')),
 t4 AS (SELECT proto, 4 AS tier, lon, lat FROM w JOIN (SELECT nation, avg(lon) AS lon, avg(lat) AS lat FROM {PLACES} p GROUP BY 1) g ON nation = CAST(split_part(stem, ' ', 2) AS INTEGER) WHERE {_BOX})
 SELECT proto, coalesce(tier, 5) AS tier, round(lon, 6) AS lon, round(lat, 6) AS lat FROM w LEFT JOIN (SELECT * FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4) QUALIFY row_number() OVER (PARTITION BY proto ORDER BY tier) = 1) USING (proto)""")
def j14_all(spark, d):
    """A point for each looked-up name: a place of that name in the region, else the largest cluster of places that start with
    it, else a checked anchor, else its district, else none."""
    g = kept(named(spark, d).select("place_id", "name", "lon", "lat"), "named")
    stem = g.filter("name not like 'gate%'").select(F.substring_index("name", " ", 2).alias("stem")).distinct()
    w = kept(stem.withColumn("proto", F.when(F.length("stem") % 2 == 0, F.concat("stem", F.lit(" ring"))).otherwise(F.col("stem"))).withColumn("nation", F.substring_index("stem", " ", -1).cast("int")), "wanted")
    box = F.col("lon").between(113.95, 114.35) & F.col("lat").between(22.2, 22.5)
    o = g.groupBy(F.col("name").alias("proto")).agg(F.min_by("lon", "place_id").alias("lon"), F.min_by("lat", "place_id").alias("lat")).filter(box)
    t1 = w.join(o, "proto").select("proto", F.lit(1).alias("tier"), "lon", "lat")
    m = sp.prefix_members(w.select("proto"), g.select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), "proto", "name").select("proto", "lon", "lat").distinct()
    m = m.withColumn("id", F.round((F.col("lon") + 180) * 1e6).cast("long") * 200_000_000 + F.round((F.col("lat") + 90) * 1e6).cast("long"))
    t2 = sp.largest_balls(kept(m, "members"), "proto", 1000, metres, SCALE).filter(box).join(w.filter("proto = stem").select("proto"), "proto", "left_semi").select("proto", F.lit(2).alias("tier"), "lon", "lat")
    checked = anchors(spark, d).groupBy("nation").agg(F.min_by("lon", "anchor_id").alias("lon"), F.min_by("lat", "anchor_id").alias("lat"))
    t3 = w.filter("stem like 'old%'").join(checked, "nation").select("proto", F.lit(3).alias("tier"), "lon", "lat")
    district = places(spark, d).groupBy("nation").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).filter(box)
    t4 = w.join(district, "nation").select("proto", F.lit(4).alias("tier"), "lon", "lat")
    best = t1.union(t2).union(t3).union(t4).groupBy("proto").agg(F.min(F.struct("tier", "lon", "lat")).alias("b"))
    return w.select("proto").join(best, "proto", "left").select("proto", F.coalesce("b.tier", F.lit(5)).alias("tier"), F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))
