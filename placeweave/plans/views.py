"""Queries: the viewer's questions, sources and sinks at row level."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators.match import best, sized
from placeweave.sources import files as fl

from .base import PLACES, STORY, places, query, read, story


@query("v1_l6_search", f"WITH h AS (SELECT 'place' AS kind, place_id AS id FROM {PLACES} p WHERE contains(lower(name), '#00000012') UNION ALL SELECT 'part', p_partkey FROM part WHERE contains(lower(p_name), 'gear') UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE contains(lower(n_name), '12')) SELECT kind, count(*) AS hits, least(50, count(*)) AS shown, list_sort(list(id))[1:3] AS first_ids FROM h GROUP BY kind")
def v1(spark, d):
    def hits(kind, df, name, key, needle):
        return df.filter(F.contains(F.lower(name), F.lit(needle))).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))

    h = hits("place", places(spark, d), "name", "place_id", "#00000012").union(hits("part", read(spark, d, "part"), "p_name", "p_partkey", "gear")).union(hits("nation", read(spark, d, "nation"), "n_name", "n_nationkey", "12"))
    first = h.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter("rn <= 3").groupBy("kind").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    h = h.groupBy("kind").agg(F.count("*").alias("hits")).join(first, "kind")
    return h.select("kind", "hits", F.least(F.lit(50), "hits").alias("shown"), "first_ids")


@query("v2_chapter_page", f"SELECT chapter, title, count(*) AS events, count(DISTINCT person) AS people FROM {STORY} s GROUP BY 1, 2")
def v2(spark, d):
    return story(spark, d).groupBy("chapter", "title").agg(F.count("*").alias("events"), F.count_distinct("person").alias("people"))


@query("v3_v4_place_page", f"SELECT p.place_id, p.name, count(o_orderkey) AS events FROM {PLACES} p LEFT JOIN orders ON o_custkey = p.place_id GROUP BY 1, 2")
def v3(spark, d):
    p = places(spark, d)
    return p.join(read(spark, d, "orders"), F.col("o_custkey") == F.col("place_id"), "left").groupBy("place_id", "name").agg(F.count("o_orderkey").alias("events"))


@query("v5_v6_chronicle_view", "SELECT o_custkey AS entry, len(list_filter(list(o_orderstatus), lambda s: s = 'F')) AS roles, CASE WHEN bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN 'model' END AS period FROM orders GROUP BY 1")
def v5(spark, d):
    g = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("entry")).agg(F.collect_list("o_orderstatus").alias("s"), F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("m"))
    return g.select("entry", F.size(F.filter("s", lambda s: s == "F")).cast("long").alias("roles"), F.when(F.col("m"), "model").alias("period"))


@query("v7_entry_relations", "SELECT e.l_orderkey AS entry, p_name AS title FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) e JOIN part ON p_partkey = l_partkey")
def v7(spark, d):
    e = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return e.join(read(spark, d, "part"), "p_partkey").select(F.col("l_orderkey").alias("entry"), F.col("p_name").alias("title"))


@query("v8_chapter_strip", f"WITH t AS (SELECT chapter, title FROM {STORY} s WHERE value > 150 QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY value DESC, event_id) = 1), c AS (SELECT unnest(range(1, 41)) AS chapter) SELECT c.chapter, coalesce(t.title, CAST(c.chapter AS VARCHAR)) AS label FROM c LEFT JOIN t ON t.chapter = c.chapter")
def v8(spark, d):
    s = story(spark, d).filter("value > 150")
    t = s.groupBy("chapter").agg(F.max_by("title", F.struct("value", -F.col("event_id"))).alias("title"))
    span = s.agg(F.lit(1).alias("lo")).select(F.explode(F.sequence(F.col("lo"), F.lit(40))).alias("chapter"))
    return span.join(t, "chapter", "left").select(F.col("chapter").cast("long").alias("chapter"), F.coalesce("title", F.col("chapter").cast("string")).alias("label"))


@query("v9_timeline_filter", f"SELECT event_id FROM {STORY} s WHERE title IN ('click', 'error') AND person BETWEEN 10 AND 30 AND k <= 60 AND value > 5")
def v9(spark, d):
    return story(spark, d).filter("title in ('click', 'error') and person between 10 and 30 and k <= 60 and value > 5").select("event_id")


@query("v10_map_slice", f"SELECT place_id, CASE WHEN nation = 7 THEN 'current' ELSE 'near' END AS style FROM {PLACES} p WHERE score > -500 AND nation BETWEEN 4 AND 10")
def v10(spark, d):
    return places(spark, d).filter("score > -500 and nation between 4 and 10").select("place_id", F.when(F.col("nation") == 7, "current").otherwise("near").alias("style"))


@query("s6_gazetteer_keys", "WITH k AS (SELECT unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS key, p_partkey, p_size FROM part) SELECT key, p_partkey FROM k WHERE length(key) >= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_size DESC, p_partkey) = 1")
def s6(spark, d):
    k = read(spark, d, "part").select(F.explode(F.array("p_name", F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1))).alias("key"), "p_partkey", "p_size").filter("length(key) >= 2")
    return k.groupBy("key").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("p_partkey"))


@query("s8_first_json")
def s8(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", fl.extract_json(F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n``` done"))).alias("json")).select("event_id", F.get_json_object("json", "$.k").cast("int").alias("k"))


@query("s10_report_document", "SELECT r_name, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS body FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def s10(spark, d):
    x = read(spark, d, "nation").join(sized(read(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return x.groupBy("r_name").agg(F.expr("listagg(n_name, '\\n') within group (order by n_nationkey)").alias("body"))


@query("s11_features", "SELECT '{\"type\":\"Feature\",\"id\":\"' || c_custkey || '\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || c_nationkey || ',' || c_custkey || ']},\"properties\":{\"c_name\":\"' || c_name || '\"}}' AS value FROM customer")
def s11(spark, d):
    c = read(spark, d, "customer").withColumn("lon", F.col("c_nationkey").cast("long"))
    return fl.to_features(c, "c_custkey", "lon", "c_custkey", ["c_name"])


@query("s12_completed_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def s12(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()


@query("s13_content_cache", "WITH c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE lang = 'en') SELECT doc_id, c.key IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.key = sha256(d.text)")
def s13(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    return x.join(x.filter("lang = 'en'").select("key", F.lit(True).alias("h")).distinct(), "key", "left").select("doc_id", F.coalesce("h", F.lit(False)).alias("hit"))


@query("s14_upsert", "WITH o AS (SELECT c_custkey AS k, 'old' AS v FROM customer), n AS (SELECT DISTINCT o_custkey AS k, 'new' AS v FROM orders WHERE o_orderstatus = 'P') SELECT k, v FROM n UNION ALL SELECT k, v FROM o ANTI JOIN n USING (k)")
def s14(spark, d):
    old = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")).distinct()
    return fl.upsert(old, new, "k")


@query("s15_sync_diff", "WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, sha256(CASE WHEN source = 'src1' THEN lower(text) ELSE text END) AS h FROM documents WHERE lang <> 'es') SELECT CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1")
def s15(spark, d):
    x = read(spark, d, "documents")
    a = x.filter("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("a"))
    b = x.filter("lang <> 'es'").select("doc_id", F.sha2(F.when(F.col("source") == "src1", F.lower("text")).otherwise(F.col("text")), 256).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("s17_dataset_counts", " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in ("documents", "events", "part", "orders", "labels")))
def s17(spark, d):
    out = None
    for t in ("documents", "events", "part", "orders", "labels"):
        one = read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("dataset"), "n")
        out = one if out is None else out.union(one)
    return out


@query("s18_export_view", f"SELECT event_id, '{{\"chapter\":' || chapter || ',\"title\":\"' || title || '\"}}' AS json FROM {STORY} s WHERE value > 100")
def s18(spark, d):
    return story(spark, d).filter("value > 100").select("event_id", F.to_json(F.struct("chapter", "title")).alias("json"))


@query("s19_route_index", "WITH r AS (SELECT l_orderkey AS route, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1) SELECT chapter, count(*) AS routes FROM (SELECT unnest(range(lo, hi + 1)) AS chapter FROM r) GROUP BY chapter")
def s19(spark, d):
    r = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("lo"), F.max("l_linenumber").cast("long").alias("hi"))
    return r.select(F.explode(F.sequence("lo", "hi")).alias("chapter")).groupBy("chapter").agg(F.count("*").alias("routes"))
