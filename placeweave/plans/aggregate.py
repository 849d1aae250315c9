"""Queries: aggregations, windows, chronicle, zones, orders and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import match as mt
from placeweave.operators.numbering import numbered

from .base import PLACES, STORY, metres, places, query, read, sql_metres, story


@query("a4_candidate_profile", f"SELECT title, count(*) AS n, count(DISTINCT chapter) AS chapters, min(chapter) AS first_ch, max(chapter) AS last_ch, round(avg(conf), 6) AS mean_conf, count(*) FILTER (k IS NULL) AS no_k, count(*) FILTER (value > 100) AS long_ones FROM {STORY} s GROUP BY title")
def a4(spark, d):
    return story(spark, d).groupBy("title").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"), F.min("chapter").alias("first_ch"), F.max("chapter").alias("last_ch"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.count_if(F.col("k").isNull()).alias("no_k"), F.count_if(F.col("value") > 100).alias("long_ones"))


@query("a4_top_names", f"SELECT person, count(*) AS n, count(DISTINCT chapter) AS chapters FROM {STORY} s GROUP BY person HAVING count(DISTINCT chapter) >= 2 ORDER BY n DESC, person LIMIT 40")
def a4b(spark, d):
    return story(spark, d).groupBy("person").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters")).filter("chapters >= 2").orderBy(F.desc("n"), "person").limit(40)


@query("a5_w8_ledger_summary", "WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1) SELECT last, count(*) AS n FROM l GROUP BY last")
def a5(spark, d):
    last = read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last"))
    return last.groupBy("last").agg(F.count("*").alias("n"))


@query("a6_rollup", "SELECT c_mktsegment AS kind, c_nationkey AS status, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def a6(spark, d):
    return read(spark, d, "customer").rollup(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("status")).agg(F.count("*").alias("n"))


@query("a6_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def a6b(spark, d):
    return read(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("a7_integration_report", f"SELECT round(100.0 * count(DISTINCT chapter) / 30, 2)::DOUBLE AS coverage, round(avg(CASE WHEN conf >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS high_share, count(*) AS n FROM {STORY} s")
def a7(spark, d):
    return story(spark, d).agg(F.round(100.0 * F.count_distinct("chapter") / 30, 2).alias("coverage"), F.round(F.avg(F.when(F.col("conf") >= 0.7, 1.0).otherwise(0.0)), 6).alias("high_share"), F.count("*").alias("n"))


@query("a8_chapter_summaries", f"WITH u AS (SELECT chapter, person, max(value) AS v FROM {STORY} s WHERE conf >= 0.3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY v DESC, person) AS rn FROM u) SELECT chapter, list(person ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY chapter")
def a8(spark, d):
    u = story(spark, d).filter("conf >= 0.3").groupBy("chapter", "person").agg(F.max("value").alias("v"))
    rn = F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("v"), "person"))
    r = u.withColumn("rn", rn).filter("rn <= 5")
    return r.groupBy("chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "person"))), lambda s: s["person"]).alias("top"))


@query("a9_appearances", f"SELECT person, min(chapter) AS first_ch, max(chapter) AS last_ch, count(DISTINCT chapter) AS n, list_sort(list(DISTINCT chapter)) AS chapters FROM {STORY} s GROUP BY person")
def a9(spark, d):
    return story(spark, d).groupBy("person").agg(F.min("chapter").alias("first_ch"), F.max("chapter").alias("last_ch"), F.count_distinct("chapter").alias("n"), F.array_sort(F.collect_set("chapter")).alias("chapters"))


@query("a10_timeline", f"SELECT event_id, 'ch' || lpad(CAST(chapter AS VARCHAR), 3, '0') AS date_sort, title FROM {STORY} s WHERE value > 40")
def a10(spark, d):
    return story(spark, d).filter("value > 40").select("event_id", F.concat(F.lit("ch"), F.lpad(F.col("chapter").cast("string"), 3, "0")).alias("date_sort"), "title")


ZONES = f"(WITH p AS (SELECT * FROM {PLACES} q), c AS (SELECT nation, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n FROM p WHERE score >= 0 GROUP BY nation) SELECT c.nation AS zone, any_value(c.lon) AS lon, any_value(c.lat) AS lat, any_value(n) AS members, least(2000, greatest(80, 1.15 * max({sql_metres('p', 'c')}) / 20)) AS radius FROM c JOIN p ON p.nation = c.nation AND p.score >= 0 GROUP BY c.nation)"


def zones(spark, d):
    p = places(spark, d).filter("score >= 0")
    c = p.groupBy("nation").agg(F.avg("lon").alias("lon_c"), F.avg("lat").alias("lat_c"), F.count("*").alias("members"))
    far = p.join(c, "nation").groupBy("nation").agg(F.max(metres(F.col("lon"), F.col("lat"), F.col("lon_c"), F.col("lat_c"))).alias("far"))
    return c.join(far, "nation").select(F.col("nation").alias("zone"), F.col("lon_c").alias("lon"), F.col("lat_c").alias("lat"), "members", F.least(F.lit(2000.0), F.greatest(F.lit(80.0), 1.15 * F.col("far") / 20)).alias("radius"))


@query("a11_zones", f"SELECT zone, round(lon, 6) AS lon, round(lat, 6) AS lat, members, round(radius, 3) AS radius FROM {ZONES} z")
def a11(spark, d):
    return zones(spark, d).select("zone", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "members", F.round("radius", 3).alias("radius"))


@query("a12_zone_merge", f"WITH RECURSIVE z AS (SELECT * FROM {ZONES} q), e AS (SELECT a.zone AS a, b.zone AS b FROM z a JOIN z b ON a.zone <> b.zone AND a.zone % 5 = b.zone % 5 AND {sql_metres('a', 'b')} <= 3000), r(node, label) AS (SELECT zone, zone FROM z UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node) SELECT node AS zone, min(label) AS merged FROM r GROUP BY node")
def a12(spark, d):
    from placeweave.operators.graph import components

    z = zones(spark, d).withColumn("p", F.col("zone") % 5)
    left, right = z.select(F.col("zone").alias("a"), "lon", "lat", "p"), z.select(F.col("zone").alias("b"), "lon", "lat", F.col("p").alias("q"))
    near = mt.within(left, right, 3000, metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 0.0292, 0.0272)
    e = near.filter("a <> b and p = q").select("a", "b")
    return z.select("zone").join(components(e).withColumnRenamed("node", "zone"), "zone", "left").select("zone", F.coalesce("component", "zone").alias("merged"))


@query("a13_zone_union", f"SELECT source, count(*) AS n FROM (SELECT zone, 'derived' AS source FROM {ZONES} z WHERE zone NOT IN (1, 2) UNION ALL SELECT n_nationkey, 'curated' FROM nation WHERE n_nationkey IN (1, 2, 30)) GROUP BY source")
def a13(spark, d):
    own = read(spark, d, "nation").filter("n_nationkey in (1, 2, 30)").select(F.col("n_nationkey").alias("zone"))
    u = zones(spark, d).select("zone").join(own, "zone", "left_anti").withColumn("source", F.lit("derived")).unionByName(own.withColumn("source", F.lit("curated")))
    return u.groupBy("source").agg(F.count("*").alias("n"))


ENTRIES = f"(SELECT chapter, title || CAST(person % 12 AS VARCHAR) AS title, max(value) AS v, list_sort(list(DISTINCT person)) AS people, min(event_id) AS id FROM {STORY} s GROUP BY 1, 2)"


def entries(spark, d):
    s = story(spark, d)
    return s.groupBy("chapter", F.concat("title", (F.col("person") % 12).cast("string")).alias("title")).agg(F.max("value").alias("v"), F.array_sort(F.collect_set("person")).alias("people"), F.min("event_id").alias("id"))


@query("a14_same_chapter_dedup", f"SELECT chapter, title, round(v, 6) AS v, people, id FROM {ENTRIES} e")
def a14(spark, d):
    return entries(spark, d).withColumn("v", F.round("v", 6))


ISLANDS = f"(SELECT title, island, min(chapter) AS first_ch, max(chapter) AS last_ch, count(*) AS n, min(id) AS id FROM (SELECT *, sum(brk) OVER (PARTITION BY title ORDER BY chapter) AS island FROM (SELECT *, CASE WHEN chapter - lag(chapter) OVER (PARTITION BY title ORDER BY chapter) <= 2 THEN 0 ELSE 1 END AS brk FROM {ENTRIES} e)) GROUP BY title, island)"


def islands(spark, d):
    w = Window.partitionBy("title").orderBy("chapter")
    e = entries(spark, d).withColumn("brk", F.when(F.col("chapter") - F.lag("chapter").over(w) <= 2, 0).otherwise(1))
    e = e.withColumn("island", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("title", "island").agg(F.min("chapter").alias("first_ch"), F.max("chapter").alias("last_ch"), F.count("*").alias("n"), F.min("id").alias("id"))


@query("a15_w3_islands", f"SELECT title, first_ch, last_ch, n, CASE WHEN n > 1 THEN 0.9 ELSE 0.75 END::DOUBLE AS conf FROM {ISLANDS} i")
def a15(spark, d):
    return islands(spark, d).select("title", "first_ch", "last_ch", "n", F.when(F.col("n") > 1, 0.9).otherwise(0.75).alias("conf"))


@query("a16_merge_groups", f"WITH g AS (SELECT id % 40 AS g, * FROM {ISLANDS} i) SELECT g, min(id) AS keeper, min(first_ch) AS first_ch, CAST(sum(n) AS BIGINT) AS n, list_sort(list(DISTINCT title)) AS titles FROM g GROUP BY g")
def a16(spark, d):
    return islands(spark, d).groupBy((F.col("id") % 40).alias("g")).agg(F.min("id").alias("keeper"), F.min("first_ch").alias("first_ch"), F.sum("n").alias("n"), F.array_sort(F.collect_set("title")).alias("titles"))


PERIOD = "CASE WHEN k < 30 THEN 'unknown' WHEN chapter <= 9 THEN 'early' WHEN chapter <= 20 THEN 'middle' ELSE 'late' END"


def period():
    return F.when(F.col("k") < 30, "unknown").when(F.col("chapter") <= 9, "early").when(F.col("chapter") <= 20, "middle").otherwise("late")


@query("a17_periods", f"SELECT event_id, {PERIOD} AS period, CASE WHEN {PERIOD} = 'late' AND value < 5 THEN true ELSE false END AS flashback FROM {STORY} s")
def a17(spark, d):
    return story(spark, d).withColumn("period", period()).select("event_id", "period", F.coalesce((F.col("period") == "late") & (F.col("value") < 5), F.lit(False)).alias("flashback"))


@query("a18_period_histogram", f"SELECT chapter, count(*) AS n, min_by(p, event_id) FILTER (p <> 'unknown') AS first_known FROM (SELECT *, {PERIOD} AS p FROM {STORY} s) GROUP BY chapter")
def a18(spark, d):
    s = story(spark, d).withColumn("p", period())
    known = F.col("p") != "unknown"
    return s.groupBy("chapter").agg(F.count("*").alias("n"), F.min_by(F.when(known, F.col("p")), F.when(known, F.col("event_id"))).alias("first_known"))


EDGES = "(SELECT DISTINCT l_partkey % 200 AS a, l_suppkey AS b FROM lineitem)"


def edges(spark, d):
    return read(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("a"), F.col("l_suppkey").alias("b")).distinct()


@query("a19_degree", f"SELECT n, count(DISTINCT m) AS degree FROM (SELECT a AS n, b AS m FROM {EDGES} e UNION ALL SELECT b, a FROM {EDGES} e) WHERE n <> m GROUP BY n")
def a19(spark, d):
    e = edges(spark, d)
    return e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select("b", "a")).filter("n <> m").groupBy("n").agg(F.count_distinct("m").alias("degree"))


@query("a20_longest_spans", f"SELECT a, b, abs(a - b) AS span FROM {EDGES} e WHERE a < b ORDER BY span DESC, a, b LIMIT 18")
def a20(spark, d):
    return edges(spark, d).filter("a < b").select("a", "b", F.abs(F.col("a") - F.col("b")).alias("span")).orderBy(F.desc("span"), "a", "b").limit(18)


@query("a21_flow_matrix", f"SELECT a % 3 AS src, count(*) FILTER (b % 3 = 0) AS p0, count(*) FILTER (b % 3 = 1) AS p1, count(*) FILTER (b % 3 = 2) AS p2 FROM {EDGES} e GROUP BY 1")
def a21(spark, d):
    e = edges(spark, d).withColumn("src", F.col("a") % 3).withColumn("to", F.concat(F.lit("p"), (F.col("b") % 3).cast("string")))
    return e.groupBy("src").pivot("to", ["p0", "p1", "p2"]).agg(F.count("b")).na.fill(0)


@query("a22_route_precision", "SELECT o_custkey AS route, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 3) AS share, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) >= 0.6 AS approximate FROM orders GROUP BY 1")
def a22(spark, d):
    share = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("route")).agg(F.round(share, 3).alias("share"), (share >= 0.6).alias("approximate"))


@query("a23_inversions", "WITH l AS (SELECT l_orderkey, l_shipdate < lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS inv FROM lineitem) SELECT l_orderkey, count(*) FILTER (inv) AS inversions, count(*) AS n FROM l GROUP BY 1")
def a23(spark, d):
    inv = F.col("l_shipdate") < F.lag("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return read(spark, d, "lineitem").select("l_orderkey", inv.alias("inv")).groupBy("l_orderkey").agg(F.count_if("inv").alias("inversions"), F.count("*").alias("n"))


@query("a24_boundary_agreement", f"WITH b(p, lo, hi) AS (VALUES ('early', 1, 8), ('middle', 9, 21), ('late', 20, 31)) SELECT p, round(avg(CASE WHEN chapter BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS agree FROM (SELECT chapter, {PERIOD} AS p FROM {STORY} s) JOIN b USING (p) GROUP BY p")
def a24(spark, d):
    b = spark.createDataFrame([("early", 1, 8), ("middle", 9, 21), ("late", 20, 31)], "p string, lo int, hi int")
    x = story(spark, d).select("chapter", period().alias("p")).join(F.broadcast(b), "p")
    return x.groupBy("p").agg(F.round(F.avg(F.when(F.col("chapter").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0)), 6).alias("agree"))


@query("a25_link_sizes", "SELECT least(n, 5) AS size, count(*) AS orders FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def a25(spark, d):
    x = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return x.groupBy(F.least("n", F.lit(5)).alias("size")).agg(F.count("*").alias("orders"))


@query("a31_gate_ratio", "SELECT round(avg(CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS linked, avg(CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE 1.0 END) >= 0.95 AS pass FROM labels l LEFT JOIN documents d USING (doc_id)")
def a31(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", F.lit(1.0).alias("hit")), "doc_id", "left")
    share = F.avg(F.coalesce("hit", F.lit(0.0)))
    return x.agg(F.round(share, 6).alias("linked"), (share >= 0.95).alias("pass"))


@query("a33_totals", f"SELECT count(*) AS entries, count(*) FILTER (len(people) > 1) AS shared, CAST(sum(len(people)) AS BIGINT) AS links FROM {ENTRIES} e")
def a33(spark, d):
    return entries(spark, d).agg(F.count("*").alias("entries"), F.count_if(F.size("people") > 1).alias("shared"), F.sum(F.size("people")).alias("links"))


@query("w1_keep_first", "SELECT p_partkey, first_id FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first_id FROM part) WHERE p_partkey <> first_id")
def w1(spark, d):
    first = F.first_value("p_partkey").over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey"))
    return read(spark, d, "part").select("p_partkey", first.alias("first_id")).filter("p_partkey <> first_id")


@query("w2_sequential_ids", "SELECT c_custkey, 'loc_' || lpad(CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS VARCHAR), 6, '0') AS id FROM customer")
def w2(spark, d):
    """Numbers in a global order; ranges of it are numbered side by side."""
    c = numbered(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"])
    return c.select("c_custkey", F.concat(F.lit("loc_"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("id"))


@query("w4_route_compression", f"WITH f AS (SELECT person, chapter, arg_min(title, event_id) AS place FROM {STORY} s GROUP BY 1, 2), w AS (SELECT *, lag(place) OVER o AS prev, lead(place) OVER o AS nxt, count(*) OVER (PARTITION BY person) AS n FROM f WINDOW o AS (PARTITION BY person ORDER BY chapter)) SELECT person, chapter, place FROM w WHERE n >= 5 AND (prev IS NULL OR place <> prev OR nxt IS NULL OR nxt <> place)")
def w4(spark, d):
    f = story(spark, d).groupBy("person", "chapter").agg(F.min_by("title", "event_id").alias("place"))
    o = Window.partitionBy("person").orderBy("chapter")
    w = f.withColumn("prev", F.lag("place").over(o)).withColumn("nxt", F.lead("place").over(o)).withColumn("n", F.count("*").over(Window.partitionBy("person")))
    return w.filter("n >= 5 and (prev is null or place <> prev or nxt is null or nxt <> place)").select("person", "chapter", "place")


@query("w5_best_per_subject", f"SELECT person, event_id FROM {STORY} s QUALIFY row_number() OVER (PARTITION BY person ORDER BY value DESC, event_id) = 1")
def w5(spark, d):
    return story(spark, d).groupBy("person").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("w6_mode_place", f"SELECT chapter, title AS mode FROM (SELECT chapter, title, count(*) AS n, min(event_id) AS p FROM {STORY} s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY n DESC, p) = 1")
def w6(spark, d):
    c = story(spark, d).groupBy("chapter", "title").agg(F.count("*").alias("n"), F.min("event_id").alias("p"))
    return c.groupBy("chapter").agg(F.max_by("title", F.struct("n", -F.col("p"))).alias("mode"))


@query("w7_valid_runs", "WITH i AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS bad, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS isl FROM orders) SELECT o_custkey AS route, min(o_orderkey) AS first_pos, count(*) AS n FROM i WHERE NOT bad GROUP BY o_custkey, isl HAVING count(*) >= 2")
def w7(spark, d):
    bad = F.col("o_orderstatus") == "P"
    isl = F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    x = read(spark, d, "orders").withColumn("isl", isl).filter(~bad)
    return x.groupBy(F.col("o_custkey").alias("route"), "isl").agg(F.min("o_orderkey").alias("first_pos"), F.count("*").alias("n")).filter("n >= 2").drop("isl")


@query("w11_representatives", "SELECT p_brand, min_by(p_name, length(p_name) * 100000 + p_partkey) AS short_name, max_by(p_name, length(p_name) * 100000 + p_partkey) AS long_name FROM part GROUP BY p_brand")
def w11(spark, d):
    o = F.length("p_name") * 100000 + F.col("p_partkey")
    return read(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_name", o).alias("short_name"), F.max_by("p_name", o).alias("long_name"))


@query("l1_l2_order_ranks", f"SELECT event_id, row_number() OVER (PARTITION BY chapter ORDER BY {PERIOD}, title, event_id) AS place FROM {STORY} s")
def l1(spark, d):
    s = story(spark, d).withColumn("p", period())
    return s.select("event_id", F.row_number().over(Window.partitionBy("chapter").orderBy("p", "title", "event_id")).alias("place"))


@query("l3_period_groups", f"SELECT p, CASE p WHEN 'early' THEN 1 WHEN 'middle' THEN 2 WHEN 'late' THEN 3 ELSE 99 END AS rank, count(*) AS n FROM (SELECT {PERIOD} AS p FROM {STORY} s) GROUP BY p")
def l3(spark, d):
    ranks = spark.createDataFrame([("early", 1), ("middle", 2), ("late", 3)], "p string, rank int")
    g = story(spark, d).groupBy(period().alias("p")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(ranks), "p", "left").select("p", F.coalesce("rank", F.lit(99)).alias("rank"), "n")


@query("l4_top_people", f"WITH t AS (SELECT person, count(DISTINCT chapter) AS n FROM {STORY} s GROUP BY 1), c AS (SELECT DISTINCT chapter, person FROM {STORY} s) SELECT chapter, person FROM c JOIN t USING (person) QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY n DESC, person) <= 12")
def l4(spark, d):
    c = story(spark, d).select("chapter", "person").distinct()
    t = c.groupBy("person").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("n"), "person"))
    return c.join(t, "person").withColumn("rn", rn).filter("rn <= 12").select("chapter", "person")


@query("l5_first_events", f"WITH c AS (SELECT chapter, count(*) AS n FROM {STORY} s GROUP BY 1) SELECT s.chapter, event_id, greatest(n - 20, 0) AS more FROM {STORY} s JOIN c ON c.chapter = s.chapter QUALIFY row_number() OVER (PARTITION BY s.chapter ORDER BY event_id) <= 20")
def l5(spark, d):
    s = story(spark, d).select("chapter", "event_id")
    n = s.groupBy("chapter").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("chapter").orderBy("event_id"))
    return s.withColumn("rn", rn).filter("rn <= 20").join(n, "chapter").select("chapter", "event_id", F.greatest(F.col("n") - 20, F.lit(0)).alias("more"))


@query("l9_head_tail", "(SELECT doc_id, n_chars, 'head' AS part FROM documents ORDER BY n_chars, doc_id LIMIT 5) UNION ALL (SELECT doc_id, n_chars, 'tail' FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 5)")
def l9(spark, d):
    x = read(spark, d, "documents").select("doc_id", "n_chars")
    return x.orderBy("n_chars", "doc_id").limit(5).withColumn("part", F.lit("head")).union(x.orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(5).withColumn("part", F.lit("tail")))
