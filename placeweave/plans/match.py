"""Queries: joins of texts, dictionaries, tiers, boxes, bands and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import match as mt
from placeweave.operators import together as tg

from .base import ANCHORS, PLACES, STORY, anchors, metres, places, query, read, sql_metres, story

NAMES = "(SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)"
# a text table with dictionary words: an order line's part name with its status words
NOTES = "(SELECT l_orderkey AS note_id, l_linenumber AS line, 'order of ' || p_name || ' by ' || l_returnflag || l_linestatus AS note FROM lineitem JOIN part ON p_partkey = l_partkey)"


def names(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


def notes(spark, d):
    x = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    return x.select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("order of "), F.col("p_name"), F.lit(" by "), F.col("l_returnflag"), F.col("l_linestatus")).alias("note"))


@query("j1_dictionary_mentions", f"SELECT note_id, line, name FROM {NOTES} n, {NAMES} w WHERE contains(lower(note), lower(name))")
def j1(spark, d):
    return mt.mentions(notes(spark, d), names(spark, d), "note", "name").select("note_id", "line", "name")


@query("j2_roles", f"SELECT person, title, CASE WHEN max(value) > 100 THEN 'subject' ELSE 'mentioned' END AS role FROM {STORY} s GROUP BY person, title")
def j2(spark, d):
    return story(spark, d).groupBy("person", "title").agg(F.when(F.max("value") > 100, "subject").otherwise("mentioned").alias("role"))


@query("j3_link_consistency", "WITH a AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1), b AS (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT c FROM a JOIN b USING (c) WHERE a.p <> b.p")
def j3(spark, d):
    o = read(spark, d, "orders")
    s = lambda x, n: x.groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias(n))
    return s(o, "p").join(s(o.filter("o_orderstatus <> 'P'"), "q"), "c").filter("p <> q").select("c")


@query("j4_priority_match", f"""WITH e AS (SELECT event_id, chapter, 'Customer#' || lpad(CAST(person * 3 AS VARCHAR), 9, '0') AS nm, person % 25 AS nat FROM {STORY} s), p AS (SELECT * FROM {PLACES} q),
 c AS (SELECT event_id, 1 AS tier, place_id FROM e JOIN p ON p.name = e.nm UNION ALL SELECT event_id, 2, min(place_id) FROM e JOIN p ON p.nation = e.nat AND p.seg = 'BUILDING' GROUP BY 1)
 SELECT event_id, tier, place_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier, place_id) AS rn FROM c) WHERE rn = 1""")
def j4(spark, d):
    e = story(spark, d).select("event_id", F.concat(F.lit("Customer#"), F.lpad((F.col("person") * 3).cast("string"), 9, "0")).alias("name"), (F.col("person") % 25).alias("nation"))
    p = places(spark, d)
    exact = e.join(p.select("name", "place_id"), "name").select("event_id", "place_id")
    first = p.filter("seg = 'BUILDING'").groupBy("nation").agg(F.min("place_id").alias("place_id"))
    near = e.join(first, "nation").select("event_id", "place_id")
    return mt.tiered([exact, near], ["event_id"], [F.col("place_id")]).select("event_id", "tier", "place_id")


@query("j5_event_points", f"SELECT event_id, round(coalesce(p.lon, 114.17), 6) AS lon, round(coalesce(p.lat, 22.3), 6) AS lat, p.place_id IS NOT NULL AS matched FROM {STORY} s LEFT JOIN {PLACES} p ON p.place_id = s.person * 11")
def j5(spark, d):
    p = places(spark, d).select("place_id", "lon", "lat")
    x = story(spark, d).join(p, F.col("place_id") == F.col("person") * 11, "left")
    return x.select("event_id", F.round(F.coalesce("lon", F.lit(114.17)), 6).alias("lon"), F.round(F.coalesce("lat", F.lit(22.3)), 6).alias("lat"), F.col("place_id").isNotNull().alias("matched"))


@query("j6_containment_match", "WITH w AS (SELECT DISTINCT p_name AS n FROM part), t AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS g FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) SELECT n, g FROM (SELECT n, g, row_number() OVER (PARTITION BY n ORDER BY length(g) DESC, g) AS rn FROM w, t WHERE contains(n, g) OR contains(g, n)) WHERE rn = 1")
def j6(spark, d):
    w = read(spark, d, "part").select(F.col("p_name").alias("n")).distinct()
    t = w.select(F.explode(F.split("n", " ")).alias("g")).distinct()
    hits = mt.mentions(w, t, "n", "g").select("n", "g").union(mt.mentions(t, w, "g", "n").select("n", "g")).distinct()
    return mt.best(hits, ["n"], [F.desc(F.length("g")), F.col("g")])


@query("j7_people_per_place", "SELECT o_custkey AS place, list(o_orderkey ORDER BY o_orderkey) AS people FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 20 GROUP BY 1")
def j7(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("rn <= 20")
    return o.groupBy(F.col("o_custkey").alias("place")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("people"))


@query("j8_longest_place", f"WITH t AS (SELECT DISTINCT split_part(name, ' ', 1) AS g FROM {NAMES} n UNION SELECT name FROM {NAMES} n) SELECT note_id, line, arg_max(g, {{'l': length(g), 'g': g}}) AS place FROM {NOTES} n JOIN t ON contains(note, g) GROUP BY ALL")
def j8(spark, d):
    n = names(spark, d)
    t = n.select(F.substring_index("name", " ", 1).alias("g")).union(n.select("name")).distinct()
    hits = mt.mentions(notes(spark, d), t, "note", "g")
    return hits.groupBy("note_id", "line").agg(F.max_by("g", F.struct(F.length("g"), F.col("g"))).alias("place"))


@query("j9_co_occurrence", f"WITH c AS (SELECT DISTINCT chapter, k, person FROM {STORY} s) SELECT a.person AS a, b.person AS b, count(*) AS shared FROM c a JOIN c b USING (chapter, k) WHERE a.person <> b.person GROUP BY 1, 2")
def j9(spark, d):
    # a scene: a day and an attribute
    scene = F.shiftleft(F.col("chapter").cast("long"), 32).bitwiseOR(F.col("k").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return tg.shared_groups(story(spark, d).select(scene.alias("grp"), F.col("person").alias("member")))


@query("j10_containment_parent", f"WITH n AS (SELECT name FROM {NAMES} q), h AS (SELECT DISTINCT split_part(name, ' ', 1) AS parent FROM {NAMES} q) SELECT name, parent FROM n JOIN h ON contains(name, parent) AND length(parent) >= 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(parent) DESC, parent) = 1")
def j10(spark, d):
    n = names(spark, d).select("name")
    h = n.select(F.substring_index("name", " ", 1).alias("parent")).distinct().filter(F.length("parent") >= 3)
    return mt.best(mt.mentions(n, h, "name", "parent"), ["name"], [F.desc(F.length("parent")), F.col("parent")])


@query("j11_suffix_parent", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS parent FROM part) SELECT name, parent, round(CAST(0.765 AS DOUBLE), 4) AS conf FROM n JOIN g ON ends_with(name, parent) AND name <> parent QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(parent) DESC, parent) = 1")
def j11(spark, d):
    n = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    suffixes = F.transform(F.sequence(F.lit(2), F.length("name") - 2), lambda i: F.col("name").substr(i, F.length("name")))
    g = n.select(F.substring_index("name", " ", -1).alias("parent")).distinct()
    hits = n.select("name", F.explode(suffixes).alias("parent")).join(g, "parent")  # equi-join on each suffix
    return mt.best(hits, ["name"], [F.desc(F.length("parent")), F.col("parent")]).select("name", "parent", F.round(F.lit(0.85 * 0.9), 4).alias("conf"))


@query("j13_coordinate_coalesce", f"SELECT place_id, round(coalesce(CASE WHEN p.score > 5000 THEN p.lon END, a.lon, b.lon, p.lon), 6) AS lon, CASE WHEN p.score > 5000 THEN 'own' WHEN a.lon IS NOT NULL THEN 'curated' WHEN b.lon IS NOT NULL THEN 'landmark' ELSE 'raw' END AS source FROM {PLACES} p LEFT JOIN {ANCHORS} a ON a.anchor_id = p.place_id LEFT JOIN (SELECT nation, min(lon) AS lon FROM {ANCHORS} x WHERE nation < 10 GROUP BY 1) b ON b.nation = p.nation")
def j13(spark, d):
    a = anchors(spark, d)
    p = places(spark, d).join(a.select(F.col("anchor_id").alias("place_id"), F.col("lon").alias("lon_a")), "place_id", "left")
    p = p.join(a.filter("nation < 10").groupBy("nation").agg(F.min("lon").alias("lon_b")), "nation", "left")
    own = F.when(F.col("score") > 5000, F.col("lon"))
    source = F.when(own.isNotNull(), "own").when(F.col("lon_a").isNotNull(), "curated").when(F.col("lon_b").isNotNull(), "landmark").otherwise("raw")
    return p.select("place_id", F.round(F.coalesce(own, "lon_a", "lon_b", "lon"), 6).alias("lon"), source.alias("source"))


@query("j14_tier_lookup", f"SELECT p.place_id, CASE WHEN a.anchor_id IS NOT NULL AND a.lon BETWEEN 114.0 AND 114.3 THEN 1 WHEN c.n >= 2 THEN 2 WHEN p.seg = 'MACHINERY' THEN 3 ELSE 4 END AS tier FROM {PLACES} p LEFT JOIN {ANCHORS} a ON a.anchor_id = p.place_id LEFT JOIN (SELECT nation, count(*) AS n FROM {ANCHORS} x GROUP BY 1) c ON c.nation = p.nation")
def j14(spark, d):
    a = anchors(spark, d)
    p = places(spark, d).select("place_id", "nation", "seg").join(a.select(F.col("anchor_id").alias("place_id"), "lon"), "place_id", "left").join(a.groupBy("nation").agg(F.count("*").alias("n")), "nation", "left")
    return p.select("place_id", F.when(F.col("lon").between(114.0, 114.3), 1).when(F.col("n") >= 2, 2).when(F.col("seg") == "MACHINERY", 3).otherwise(4).alias("tier"))


@query("j20_chapter_bands", f"WITH c AS (SELECT DISTINCT chapter FROM {STORY} s) SELECT c.chapter, count(*) FILTER (abs(s.chapter - c.chapter) <= 1) AS near, count(*) AS wide FROM c JOIN {STORY} s ON abs(s.chapter - c.chapter) <= 3 GROUP BY c.chapter")
def j20(spark, d):
    s = story(spark, d).groupBy("chapter").agg(F.count("*").alias("n"))  # counts meet, not events
    x = mt.band_join(s.select("chapter"), s, "chapter", 3)
    return x.groupBy("chapter").agg(F.sum(F.when(F.abs(F.col("chapter") - F.col("other_chapter")) <= 1, F.col("n")).otherwise(0)).alias("near"), F.sum("n").alias("wide"))


@query("j21_interval_expansion", f"WITH p(lo, hi, label, ord) AS (VALUES (1, 9, 'opening', 1), (8, 20, 'middle', 2), (19, 40, 'end', 3)), x AS (SELECT unnest(range(lo, hi + 1)) AS chapter, label, ord FROM p), l AS (SELECT chapter, arg_max(label, ord) AS label FROM x GROUP BY 1) SELECT event_id, label FROM {STORY} s LEFT JOIN l USING (chapter)")
def j21(spark, d):
    p = spark.createDataFrame([(1, 9, "opening", 1), (8, 20, "middle", 2), (19, 40, "end", 3)], "lo int, hi int, label string, ord int")
    per = p.select(F.explode(F.sequence("lo", "hi")).alias("chapter"), "label", "ord").groupBy("chapter").agg(F.max_by("label", "ord").alias("label"))
    return story(spark, d).join(F.broadcast(per), "chapter", "left").select("event_id", "label")


@query("j22_decisions", f"SELECT event_id, CASE WHEN k = 42 THEN 'rejected' WHEN title IN ('purchase', 'signup') THEN 'approved' ELSE 'pending' END AS status FROM {STORY} s")
def j22(spark, d):
    rule = spark.createDataFrame([("purchase", "approved"), ("signup", "approved")], "title string, by_rule string")
    own = spark.createDataFrame([(42, "rejected")], "k int, by_subject string")
    x = story(spark, d).join(F.broadcast(rule), "title", "left").join(F.broadcast(own), "k", "left")
    return x.select("event_id", F.coalesce("by_subject", "by_rule", F.lit("pending")).alias("status"))


@query("j23_rule_first_merge", "SELECT doc_id, 'rule' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'model' FROM documents WHERE n_chars < 600 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j23(spark, d):
    rule = read(spark, d, "labels").filter("toxic = 1").select("doc_id")
    model = read(spark, d, "documents").filter("n_chars < 600").select("doc_id").join(rule, "doc_id", "left_anti")
    return rule.withColumn("origin", F.lit("rule")).unionByName(model.withColumn("origin", F.lit("model")))


@query("j24_j25_pending_work", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j24(spark, d):
    done = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return read(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("j26_foreign_keys", "SELECT 'lineitem.part' AS fk, count(*) AS broken FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500) UNION ALL SELECT 'labels.document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def j26(spark, d):
    def broken(name, left, lk, right, rk):
        return left.select(F.col(lk).alias("k")).join(right.select(F.col(rk).alias("k")), "k", "left_anti").agg(F.count("*").alias("broken")).select(F.lit(name).alias("fk"), "broken")

    r = lambda n: read(spark, d, n)
    return broken("lineitem.part", r("lineitem"), "l_partkey", r("part").filter("p_size > 5"), "p_partkey").union(broken("orders.customer", r("orders"), "o_custkey", r("customer").filter("c_acctbal > -500"), "c_custkey")).union(broken("labels.document", r("labels"), "doc_id", r("documents"), "doc_id"))


@query("j27_orphan_repair", f"WITH dict AS (SELECT key, min(place_id) AS place_id FROM (SELECT name AS key, place_id FROM {PLACES} p WHERE score > 0 UNION ALL SELECT 'alias' || CAST(place_id AS VARCHAR), place_id FROM {PLACES} p WHERE score > 0) GROUP BY 1) SELECT event_id, coalesce(a.place_id, b.place_id) AS place_id FROM {STORY} s LEFT JOIN dict a ON a.key = 'Customer#' || lpad(CAST(s.person AS VARCHAR), 9, '0') LEFT JOIN dict b ON b.key = 'alias' || CAST(s.k AS VARCHAR)")
def j27(spark, d):
    p = places(spark, d).filter("score > 0")
    keys = F.explode(F.array("name", F.concat(F.lit("alias"), F.col("place_id").cast("string"))))
    dic = p.select(keys.alias("key"), "place_id").groupBy("key").agg(F.min("place_id").alias("place_id"))
    s = story(spark, d).select("event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("person").cast("string"), 9, "0")).alias("ka"), F.concat(F.lit("alias"), F.col("k").cast("string")).alias("kb"))
    x = s.join(dic.select(F.col("key").alias("ka"), F.col("place_id").alias("pa")), "ka", "left").join(dic.select(F.col("key").alias("kb"), F.col("place_id").alias("pb")), "kb", "left")
    return x.select("event_id", F.coalesce("pa", "pb").alias("place_id"))


@query("j28_coordinate_propagation", f"SELECT o_custkey AS route, list(round(p.lon, 4) ORDER BY o_orderkey) AS lons FROM orders JOIN {PLACES} p ON p.place_id = o_custkey % 97 + 1 GROUP BY 1")
def j28(spark, d):
    p = places(spark, d).select("place_id", F.round("lon", 4).alias("lon"))
    x = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("route"), (F.col("o_custkey") % 97 + 1).alias("place_id")).join(p, "place_id")
    return x.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "lon"))), lambda s: s["lon"]).alias("lons"))


@query("j29_reverse_links", "SELECT l_partkey AS member, list_sort(list(DISTINCT l_suppkey)) AS zones FROM lineitem GROUP BY 1")
def j29(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("zones"))


@query("j30_reference_rewrite", "WITH m AS (SELECT c_custkey AS a, c_custkey - c_custkey % 10 + 1 AS b FROM customer WHERE c_mktsegment = 'BUILDING') SELECT o_orderpriority, list_sort(list(DISTINCT coalesce(m.b, o_custkey))) AS people FROM orders LEFT JOIN m ON a = o_custkey GROUP BY 1")
def j30(spark, d):
    m = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") - F.col("c_custkey") % 10 + 1).alias("b"))
    x = read(spark, d, "orders").join(m, "o_custkey", "left")
    return x.groupBy("o_orderpriority").agg(F.array_sort(F.collect_set(F.coalesce("b", "o_custkey"))).alias("people"))


@query("j31_corrections", f"WITH c AS (SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'set_coord' WHEN 1 THEN 'reclassify' ELSE 'exclude' END AS action, replace(s_name, 'Supplier', 'Customer') AS target FROM supplier) SELECT p.place_id, CASE WHEN action = 'set_coord' THEN 114.0 ELSE round(lon, 6) END AS lon, CASE WHEN action = 'reclassify' THEN 'OTHER' ELSE seg END AS seg, coalesce(action = 'exclude', false) AS hidden FROM {PLACES} p LEFT JOIN c ON c.target = p.name")
def j31(spark, d):
    k = F.col("s_suppkey") % 3
    c = read(spark, d, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), F.when(k == 0, "set_coord").when(k == 1, "reclassify").otherwise("exclude").alias("action"))
    p = places(spark, d).join(c, "name", "left")
    return p.select("place_id", F.when(F.col("action") == "set_coord", F.lit(114.0)).otherwise(F.round("lon", 6)).alias("lon"), F.when(F.col("action") == "reclassify", "OTHER").otherwise(F.col("seg")).alias("seg"), F.coalesce(F.col("action") == "exclude", F.lit(False)).alias("hidden"))


@query("j32_containment_pairs", "WITH w AS (SELECT DISTINCT p_name AS n FROM part), t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS n FROM part) SELECT t.n AS inner_name, w.n AS outer_name FROM t JOIN w ON contains(w.n, t.n) AND w.n <> t.n")
def j32(spark, d):
    w = read(spark, d, "part").select(F.col("p_name").alias("o")).distinct()
    t = w.select(F.explode(F.split("o", " ")).alias("i")).distinct()
    # a three-letter block key: whatever holds the inner name holds its first three letters
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("o") - 2), lambda k: F.col("o").substr(k, F.lit(3))))
    hits = t.withColumn("g", F.substring("i", 1, 3)).join(w.select("o", F.explode(grams).alias("g")), "g")
    return hits.filter(F.contains("o", "i") & (F.col("o") != F.col("i"))).select(F.col("i").alias("inner_name"), F.col("o").alias("outer_name")).distinct()


@query("j33_gap_links", f"SELECT event_id, p.place_id FROM {STORY} s JOIN {PLACES} p ON p.name = 'Customer#' || lpad(CAST(s.person AS VARCHAR), 9, '0') WHERE s.k IS NULL OR s.k < 50")
def j33(spark, d):
    s = story(spark, d).filter("k is null or k < 50").select("event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("person").cast("string"), 9, "0")).alias("name"))
    return s.join(places(spark, d).select("name", "place_id"), "name").select("event_id", "place_id")


@query("j34_route_geometry", f"WITH w AS (SELECT o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_custkey * 7 % 3000 + o_orderkey % 5 AS place FROM orders), j AS (SELECT w.*, p.lon FROM w LEFT JOIN {PLACES} p ON p.place_id = w.place) SELECT route, count(*) AS waypoints, count(lon) AS located, CASE WHEN count(*) < 2 THEN 'short' WHEN count(lon) < 2 THEN 'unlocated' ELSE 'ok' END AS reason, list(place ORDER BY pos) FILTER (lon IS NULL) AS missing FROM j GROUP BY route")
def j34(spark, d):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    w = read(spark, d, "orders").select(F.col("o_custkey").alias("route"), pos.alias("pos"), (F.col("o_custkey") * 7 % 3000 + F.col("o_orderkey") % 5).alias("place_id"))
    j = w.join(places(spark, d).select("place_id", "lon"), "place_id", "left")
    gone = F.transform(F.array_sort(F.collect_list(F.when(F.col("lon").isNull(), F.struct("pos", "place_id")))), lambda s: s["place_id"])
    g = j.groupBy("route").agg(F.count("*").alias("waypoints"), F.count("lon").alias("located"), gone.alias("missing"))
    return g.select("route", "waypoints", "located", F.when(F.col("waypoints") < 2, "short").when(F.col("located") < 2, "unlocated").otherwise("ok").alias("reason"), F.when(F.size("missing") > 0, F.col("missing")).alias("missing"))


@query("u1_set_difference", "SELECT 'customer' AS side, c_custkey AS k FROM customer ANTI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'label', doc_id FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)")
def u1(spark, d):
    a = read(spark, d, "customer").select("c_custkey").subtract(read(spark, d, "orders").select("o_custkey"))
    b = read(spark, d, "labels").select("doc_id").exceptAll(read(spark, d, "documents").filter("lang = 'en'").select("doc_id"))
    return a.select(F.lit("customer").alias("side"), F.col("c_custkey").alias("k")).union(b.select(F.lit("label"), "doc_id"))


@query("u2_u4_array_sets", f"WITH p AS (SELECT person, list_sort(list(DISTINCT chapter)) AS ch FROM {STORY} s GROUP BY 1) SELECT a.person, len(list_intersect(a.ch, b.ch)) AS shared, len(list_distinct(list_concat(a.ch, b.ch))) AS total, list_has_all(b.ch, a.ch) AS subset FROM p a JOIN p b ON b.person = a.person + 1")
def u2(spark, d):
    p = story(spark, d).groupBy("person").agg(F.collect_set("chapter").alias("ch"))
    j = p.join(p.select((F.col("person") - 1).alias("person"), F.col("ch").alias("b")), "person")
    return j.select("person", F.size(F.array_intersect("ch", "b")).cast("long").alias("shared"), F.size(F.array_union("ch", "b")).cast("long").alias("total"), (F.size(F.array_except("ch", "b")) == 0).alias("subset"))


@query("u5_u6_supersede", "WITH new AS (SELECT doc_id, 'new' AS v FROM labels WHERE quality = 0) SELECT doc_id, v FROM new UNION ALL SELECT doc_id, 'old' FROM labels ANTI JOIN new USING (doc_id)")
def u5(spark, d):
    lab = read(spark, d, "labels")
    new = lab.filter("quality = 0").select("doc_id")
    return new.withColumn("v", F.lit("new")).unionByName(lab.select("doc_id").join(new, "doc_id", "left_anti").withColumn("v", F.lit("old")))


@query("j12_anchor_parents", f"WITH t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS parent FROM part), c AS (SELECT note_id, line, 1 AS tier, parent FROM {NOTES} n JOIN t ON contains(note, 'of ' || parent) WHERE length(parent) >= 3 UNION ALL SELECT note_id, line, 2, parent FROM {NOTES} n JOIN t ON contains(note, parent) WHERE length(parent) >= 3) SELECT note_id, line, tier, parent FROM c QUALIFY row_number() OVER (PARTITION BY note_id, line ORDER BY tier, length(parent) DESC, parent) = 1")
def j12(spark, d):
    t = names(spark, d).select(F.substring_index("name", " ", 1).alias("parent")).distinct().filter(F.length("parent") >= 3)
    own = notes(spark, d)
    hits = mt.mentions(own, t, "note", "parent")
    near = hits.filter(F.contains("note", F.concat(F.lit("of "), F.col("parent")))).select("note_id", "line", "parent")
    x = mt.tiered([near, hits.select("note_id", "line", "parent")], ["note_id", "line"], [F.desc(F.length("parent")), F.col("parent")])
    return x.select("note_id", "line", "tier", "parent")
