"""Queries: entity resolution and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import actions as ac
from placeweave.operators import graph as gr
from placeweave.operators import match as mt
from placeweave.operators import spread as sp

from .base import ANCHORS, PLACES, STORY, anchors, metres, places, query, read, sql_metres, story

#: Metres of a degree of longitude and of latitude.
SCALE = (0.9248 * 111320.0, 110570.0)


@query("e1_e2_alias_rules", "SELECT p_name AS name, list_sort(list(DISTINCT p_brand)) AS aliases FROM (SELECT CASE WHEN p_name LIKE 'old %' THEN replace(p_name, 'old ', 'new ') ELSE p_name END AS p_name, p_brand FROM part WHERE p_name NOT LIKE 'hot %') GROUP BY 1")
def e1(spark, d):
    p = read(spark, d, "part").filter(~F.col("p_name").startswith("hot "))
    name = F.when(F.col("p_name").startswith("old "), F.replace("p_name", F.lit("old "), F.lit("new "))).otherwise(F.col("p_name"))
    return p.groupBy(name.alias("name")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))


@query("e4_place_grouping", "SELECT slug, arg_max(p_name, length(p_name) * 100 - p_size) AS name, list_sort(list(DISTINCT p_size)) AS chapters, count(*) FILTER (p_size > 25) > 0.5 * count(*) AS fictional, round(avg(p_retailprice), 2) AS conf FROM (SELECT replace(p_name, ' ', '_') AS slug, * FROM part) GROUP BY slug")
def e4(spark, d):
    p = read(spark, d, "part").withColumn("slug", F.replace("p_name", F.lit(" "), F.lit("_")))
    return p.groupBy("slug").agg(F.max_by("p_name", F.length("p_name") * 100 - F.col("p_size")).alias("name"), F.array_sort(F.collect_set("p_size")).alias("chapters"), (F.count_if(F.col("p_size") > 25) > 0.5 * F.count("*")).alias("fictional"), F.round(F.avg("p_retailprice"), 2).alias("conf"))


# people share an alias if they have a nation and a rounded balance, or a balance to five cents, in common
PAIRS = "(SELECT c_custkey AS a, 10000000 + c_nationkey * 1000 + CAST(floor((c_acctbal + 1000) / 100) AS BIGINT) AS b FROM customer UNION SELECT c_custkey, 20000000 + CAST(floor((c_acctbal + 1000) * 20) AS BIGINT) FROM customer)"


@query("e5_g1_alias_components", f"WITH RECURSIVE e AS (SELECT a, b FROM {PAIRS} p UNION SELECT b, a FROM {PAIRS} p), r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node) SELECT node, min(label) AS component FROM r GROUP BY node")
def e5(spark, d):
    c, a = read(spark, d, "customer"), F.col("c_custkey").alias("a")
    x = c.select(a, (10000000 + F.col("c_nationkey") * 1000 + F.floor((F.col("c_acctbal") + 1000) / 100)).alias("b"))
    return gr.components(x.union(c.select(a, 20000000 + F.floor((F.col("c_acctbal") + 1000) * 20))))


@query("e6_vague_names", "SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part WHERE split_part(p_name, ' ', 1) IN ('new', 'old') GROUP BY 1")
def e6(spark, d):
    return read(spark, d, "part").filter(F.substring_index("p_name", " ", 1).isin("new", "old")).groupBy("p_name").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("e7_alias_pruning", "WITH c AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2), o AS (SELECT p_brand, count(DISTINCT p_name) AS owners FROM part GROUP BY 1) SELECT p_name, p_brand FROM c JOIN o USING (p_brand) WHERE n >= 2 AND owners < 60")
def e7(spark, d):
    c = read(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"))
    o = c.groupBy("p_brand").agg(F.count("*").alias("owners"))
    return c.filter("n >= 2").join(o.filter("owners < 60"), "p_brand").select("p_name", "p_brand")


@query("e9_variant_groups", "SELECT key, list_sort(list(DISTINCT p_name)) AS names FROM (SELECT regexp_replace(p_name, '[aeiou ]|[^aeiou ]{2}', '', 'g') AS key, p_name FROM part) GROUP BY key HAVING count(DISTINCT p_name) >= 2")
def e9(spark, d):
    x = read(spark, d, "part").select(F.regexp_replace("p_name", "[aeiou ]|[^aeiou ]{2}", "").alias("key"), "p_name")
    return x.groupBy("key").agg(F.array_sort(F.collect_set("p_name")).alias("names")).filter("size(names) >= 2")


@query("e10_variant_propagation", "WITH s AS (SELECT p_name, arg_max(p_partkey, p_retailprice * 100000 - p_partkey) AS strongest, max(p_retailprice) AS top FROM part GROUP BY 1) SELECT p_partkey, strongest, round(top * 0.95, 4) AS conf FROM part JOIN s USING (p_name) WHERE p_partkey <> strongest AND p_retailprice < 0.97 * top")
def e10(spark, d):
    p = read(spark, d, "part")
    s = p.groupBy("p_name").agg(F.max_by("p_partkey", F.col("p_retailprice") * 100000 - F.col("p_partkey")).alias("strongest"), F.max("p_retailprice").alias("top"))
    return p.join(s, "p_name").filter("p_partkey <> strongest and p_retailprice < 0.97 * top").select("p_partkey", "strongest", F.round(F.col("top") * 0.95, 4).alias("conf"))


@query("e11_chapter_clusters", f"WITH m AS (SELECT nation AS chapter, place_id, lon, lat FROM {PLACES} p), d AS (SELECT a.chapter, max({sql_metres('a', 'b')}) AS spread FROM m a JOIN m b USING (chapter) GROUP BY 1) SELECT m.chapter, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, round(any_value(spread), 2) AS spread, round(greatest(0, 0.72 - 0.17 * any_value(spread) / 500), 4) AS conf FROM m JOIN d ON d.chapter = m.chapter GROUP BY m.chapter HAVING count(*) >= 2")
def e11(spark, d):
    m = places(spark, d).select(F.col("nation").alias("chapter"), "lon", "lat")
    spread = sp.spreads(sp.hulls(m, "chapter"), "chapter", SCALE)  # the two farthest are corners of the hull
    c = m.groupBy("chapter").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count("*").alias("n")).filter("n >= 2")
    return c.join(spread, "chapter").select("chapter", "lon", "lat", F.round("spread", 2).alias("spread"), F.round(F.greatest(F.lit(0.0), 0.72 - 0.17 * F.col("spread") / 500), 4).alias("conf"))


@query("e13_merge_proposals", "WITH n AS (SELECT p_name, array_to_string(list_sort(string_split(split_part(p_name, ' ', 1), '')), '') AS key, count(*) AS n FROM part GROUP BY 1, 2), c AS (SELECT *, first_value(p_name) OVER (PARTITION BY key ORDER BY n DESC, length(p_name), p_name) AS canon FROM n) SELECT p_name, canon FROM c WHERE p_name <> canon")
def e13(spark, d):
    key = F.array_join(F.array_sort(F.split(F.substring_index("p_name", " ", 1), "")), "")
    n = read(spark, d, "part").groupBy("p_name", key.alias("key")).agg(F.count("*").alias("n"))
    canon = F.first_value("p_name").over(Window.partitionBy("key").orderBy(F.desc("n"), F.length("p_name"), "p_name"))
    return n.select("p_name", canon.alias("canon")).filter("p_name <> canon")


@query("e17_provenance", "SELECT l.doc_id, CASE WHEN d.lang = 'en' THEN l.toxic END AS backed FROM labels l LEFT JOIN documents d USING (doc_id)")
def e17(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left")
    return x.select("doc_id", F.when(F.col("lang") == "en", F.col("toxic")).alias("backed"))


@query("e20_fictional_anchoring", f"WITH p AS (SELECT * FROM {PLACES} q), c AS (SELECT nation, avg(lon) AS lon FROM p WHERE seg = 'BUILDING' AND lon BETWEEN 114.0 AND 114.3 GROUP BY 1) SELECT p.place_id, CASE WHEN a.anchor_id IS NOT NULL THEN 'parent' WHEN c.nation IS NOT NULL THEN 'chapter' ELSE 'default' END AS source, round(coalesce(a.lon, c.lon, 114.17), 6) AS lon FROM p LEFT JOIN {ANCHORS} a ON a.anchor_id = p.place_id LEFT JOIN c ON c.nation = p.nation AND p.nation < 20 WHERE p.score < 0")
def e20(spark, d):
    p = places(spark, d)
    c = p.filter("seg = 'BUILDING' and lon between 114.0 and 114.3 and nation < 20").groupBy("nation").agg(F.avg("lon").alias("lon_c"))
    x = p.filter("score < 0").join(anchors(spark, d).select(F.col("anchor_id").alias("place_id"), F.col("lon").alias("lon_a")), "place_id", "left").join(c, "nation", "left")
    return x.select("place_id", F.when(F.col("lon_a").isNotNull(), "parent").when(F.col("lon_c").isNotNull(), "chapter").otherwise("default").alias("source"), F.round(F.coalesce("lon_a", "lon_c", F.lit(114.17)), 6).alias("lon"))


@query("e21_largest_ball", f"WITH p AS (SELECT * FROM {PLACES} q), n AS (SELECT a.nation, a.place_id, count(*) AS n, avg(b.lon) AS lon FROM p a JOIN p b USING (nation) WHERE {sql_metres('a', 'b')} <= 20000 GROUP BY 1, 2) SELECT nation, place_id, n, round(lon, 6) AS lon FROM n WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, place_id) = 1")
def e21(spark, d):
    p = places(spark, d).select("nation", F.col("place_id").alias("id"), "lon", "lat")
    return sp.largest_balls(p, "nation", 20000, metres, SCALE).select("nation", F.col("id").alias("place_id"), "n", F.round("lon", 6).alias("lon"))


@query("e22_place_build", "SELECT p_name, p_partkey, p_retailprice AS conf FROM part WHERE p_retailprice >= 960 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def e22(spark, d):
    p = read(spark, d, "part").filter("p_retailprice >= 960").select("p_name", "p_partkey", F.col("p_retailprice").alias("conf"))
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.min_by("conf", "p_partkey").alias("conf"))


@query("e23_round_robin_top_up", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_size > 10) ORDER BY rn, p_brand LIMIT 120")
def e23(spark, d):
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return read(spark, d, "part").filter("p_size > 10").withColumn("rn", rn).orderBy("rn", "p_brand").limit(120).select("p_brand", "p_partkey")


@query("e24_e25_publish", f"SELECT place_id, substr(name, 1, 12) AS title, CASE WHEN nation < 5 THEN 'district' ELSE 'fictional' END AS precision, CASE WHEN score >= 7000 THEN 'approved' ELSE 'needs_review' END AS status, least(3, greatest(0, CAST(floor(score / 2500) AS INTEGER))) AS spoiler FROM {PLACES} p")
def e24(spark, d):
    return places(spark, d).select("place_id", F.substring("name", 1, 12).alias("title"), F.when(F.col("nation") < 5, "district").otherwise("fictional").alias("precision"), F.when(F.col("score") >= 7000, "approved").otherwise("needs_review").alias("status"), F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col("score") / 2500).cast("int"))).alias("spoiler"))


LINKS = "(SELECT c_custkey AS a, CAST(floor(c_custkey / 3) AS BIGINT) AS b FROM customer WHERE c_custkey >= 3)"


@query("g2_closure", f"WITH RECURSIVE l AS (SELECT * FROM {LINKS} q), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT a, b AS root FROM r WHERE b NOT IN (SELECT a FROM l)")
def g2(spark, d):
    links = read(spark, d, "customer").filter("c_custkey >= 3").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).alias("b"))
    return gr.closure(links)


@query("g3_redirect_edges", f"WITH RECURSIVE l AS (SELECT * FROM {LINKS} q), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), t AS (SELECT a, b AS root FROM r WHERE b NOT IN (SELECT a FROM l)), e AS (SELECT DISTINCT o_custkey AS a, o_custkey * 2 % 1500 + 1 AS b FROM orders) SELECT DISTINCT coalesce(x.root, e.a) AS a, coalesce(y.root, e.b) AS b FROM e LEFT JOIN t x ON x.a = e.a LEFT JOIN t y ON y.a = e.b WHERE coalesce(x.root, e.a) <> coalesce(y.root, e.b)")
def g3(spark, d):
    e = read(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 2 % 1500 + 1).alias("b")).distinct()
    return gr.redirect(e, g2(spark, d))


@query("g4_merge_groups", f"WITH g AS (SELECT k, list_sort(list(DISTINCT event_id)) AS ids, max(chapter) - min(chapter) AS span FROM {STORY} s WHERE k IS NOT NULL GROUP BY k, title, person) SELECT DISTINCT ids, span FROM g WHERE len(ids) >= 2 AND span <= 20")
def g4(spark, d):
    s = story(spark, d).filter("k is not null").groupBy("k", "title", "person").agg(F.array_sort(F.collect_set("event_id")).alias("ids"), (F.max("chapter") - F.min("chapter")).alias("span"))
    return s.filter("size(ids) >= 2 and span <= 20").dropDuplicates(["ids"]).select("ids", "span")


@query("g5_edge_checks", "WITH e AS (SELECT DISTINCT l_partkey % 300 AS a, l_suppkey AS b FROM lineitem), n AS (SELECT s_suppkey AS id FROM supplier) SELECT e.a, e.b, CASE WHEN e.a = e.b THEN 'self' WHEN e.a NOT IN (SELECT id FROM n) THEN 'missing' WHEN r.a IS NOT NULL THEN 'cycle' WHEN e.a > e.b THEN 'order' ELSE 'ok' END AS verdict FROM e LEFT JOIN e r ON r.a = e.b AND r.b = e.a")
def g5(spark, d):
    e = read(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("a"), F.col("l_suppkey").alias("b")).distinct()
    n = read(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lit(1).alias("known"))
    x = e.join(n, "a", "left").join(e.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(1).alias("back")), ["a", "b"], "left")
    return x.select("a", "b", F.when(F.col("a") == F.col("b"), "self").when(F.col("known").isNull(), "missing").when(F.col("back") == 1, "cycle").when(F.col("a") > F.col("b"), "order").otherwise("ok").alias("verdict"))


@query("g6_open_ends", f"WITH e AS (SELECT a, b FROM {LINKS} q UNION ALL SELECT b, a FROM {LINKS} q) SELECT a AS node FROM e GROUP BY a HAVING count(DISTINCT b) = 1")
def g6(spark, d):
    links = read(spark, d, "customer").filter("c_custkey >= 3").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).alias("b"))
    both = links.union(links.select("b", "a"))
    return both.groupBy("a").agg(F.count_distinct("b").alias("n")).filter("n = 1").select(F.col("a").alias("node"))


@query("e3_typed_overrides", "WITH a AS (SELECT p_partkey, CASE WHEN p_name LIKE 'old %' THEN 'aged ' || split_part(p_name, ' ', 2) ELSE p_name END AS name, p_brand FROM part WHERE p_name NOT LIKE '% bolt'), b AS (SELECT name, list_sort(list(DISTINCT p_brand)) AS aliases FROM a GROUP BY name) SELECT name, list_filter(aliases, lambda x: x <> 'Brand#12') AS aliases FROM b")
def e3(spark, d):
    """Ordered actions from typed tables: bulk remove, rename, then remove alias."""
    gone = spark.createDataFrame([("bolt",)], "word string")
    rename = spark.createDataFrame([("old", "aged")], "head string, new string")
    strip = spark.createDataFrame([("Brand#12",)], "alias string")
    p = read(spark, d, "part").select("p_name", "p_brand", F.substring_index("p_name", " ", 1).alias("head"), F.substring_index("p_name", " ", -1).alias("word"))
    p = p.join(F.broadcast(gone), "word", "left_anti").join(F.broadcast(rename), "head", "left")
    name = F.when(F.col("new").isNotNull(), F.concat_ws(" ", "new", "word")).otherwise(F.col("p_name"))
    g = p.groupBy(name.alias("name")).agg(F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    cut = strip.agg(F.collect_set("alias").alias("cut"))
    return g.join(F.broadcast(cut)).select("name", F.array_except("aliases", "cut").alias("aliases"))


@query("e14_entity_variants", "WITH n AS (SELECT p_name AS a, list_sort(list(DISTINCT p_size)) AS ch FROM part GROUP BY 1) SELECT x.a, y.a AS b, CASE WHEN len(list_intersect(x.ch, y.ch)) = 0 THEN least(0.45, CASE WHEN length(x.a) = length(y.a) THEN 0.5 ELSE 0.6 END) WHEN length(x.a) = length(y.a) THEN 0.5 ELSE 0.6 END::DOUBLE AS conf FROM n x JOIN n y ON x.a < y.a AND levenshtein(x.a, y.a) = 1 WHERE NOT (x.a LIKE 'cold %' AND y.a LIKE 'hot %')")
def e14(spark, d):
    n = read(spark, d, "part").groupBy(F.col("p_name").alias("a")).agg(F.collect_set("p_size").alias("ch"))
    cut = F.transform(F.sequence(F.lit(1), F.length("a")), lambda i: F.concat(F.col("a").substr(F.lit(1), i - 1), F.col("a").substr(i + 1, F.length("a"))))
    k = n.select("a", "ch", F.explode(F.array_distinct(F.array_union(F.array("a"), cut))).alias("key"))
    pairs = k.join(k.select(F.col("a").alias("b"), F.col("ch").alias("ch2"), "key"), "key").filter("a < b").dropDuplicates(["a", "b"]).filter(F.levenshtein("a", "b", 1) == 1)
    contrast = spark.createDataFrame([("cold", "hot")], "x string, y string")
    pairs = pairs.withColumn("x", F.substring_index("a", " ", 1)).withColumn("y", F.substring_index("b", " ", 1)).join(F.broadcast(contrast), ["x", "y"], "left_anti")
    base = F.when(F.length("a") == F.length("b"), 0.5).otherwise(0.6)
    return pairs.select("a", "b", F.when(F.size(F.array_intersect("ch", "ch2")) == 0, F.least(F.lit(0.45), base)).otherwise(base).alias("conf"))


def action_rows(spark, d):
    """Rows of people from parts, and a log of decisions about them from orders of one day."""
    p = read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type", F.reverse("p_name"), F.concat("p_type", F.lit(" "), "p_brand")).alias("aliases"))
    kinds = F.array(*[F.lit(k) for k in (ac.RENAME, ac.SPLIT, ac.REMOVE_ALIAS, ac.MERGE_ROUTES, ac.BULK_REMOVE, ac.DEFINE, ac.KEEP, ac.REMOVE, ac.MERGE_INTO)])
    s = read(spark, d, "supplier").join(p.select(F.col("p_partkey").alias("s_suppkey"), F.col("p_name").alias("subject")), "s_suppkey")
    q = p.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("other_name"), "p_brand", "p_type")
    s = s.withColumn("other", F.col("s_suppkey") + 17).join(q, "other")
    kind = F.get(kinds, (F.col("s_suppkey") % 9).cast("int"))
    named = kind.isin(ac.RENAME, ac.SPLIT, ac.MERGE_ROUTES, ac.MERGE_INTO)
    log = s.select(F.col("s_suppkey").alias("seq"), kind.alias("action"), "subject", F.when(named, F.col("other_name")).when(F.col("s_suppkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("object"), F.floor(F.col("s_suppkey") / 30).alias("block"))
    return rows, log


@query("e3_action_log")
def e3_log(spark, d):
    """All kinds of decisions replayed in the order of their log; compared with a sequential replay in the tests."""
    return ac.replay(*action_rows(spark, d))
