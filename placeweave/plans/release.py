"""Queries: decisions and inferences applied, what depends on moved places, routes, checks before a release."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import graph as gr
from placeweave.operators import match as mt
from placeweave.operators.graph import kept
from placeweave.operators.numbering import numbered

from .base import PLACES, hash_point, places, query, read, sql_point
from .zones import NAMED, named

BOX = "lon BETWEEN 113.9 AND 114.4 AND lat BETWEEN 22.2 AND 22.5"
# inferences: a line of an order says where a customer's place is, how surely, and whether that was approved
INFERRED = f"(SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey * 15 + l_linenumber AS subject, {sql_point('CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)')}, l_discount * 10 AS conf, CASE WHEN l_linestatus = 'F' THEN 'approved' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'pending' END AS status, l_quantity AS evidence FROM lineitem)"


def inferred(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lon, lat = hash_point(key)
    status = F.when(F.col("l_linestatus") == "F", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending")
    return read(spark, d, "lineitem").select(key.alias("id"), (F.col("l_suppkey") * 15 + F.col("l_linenumber")).alias("subject"), lon.alias("lon"), lat.alias("lat"), (F.col("l_discount") * 10).alias("conf"), status.alias("status"), F.col("l_quantity").alias("evidence"))


@query("e16_apply_diff", f"""WITH b AS (SELECT * FROM {INFERRED} i WHERE status = 'approved' AND {BOX} QUALIFY row_number() OVER (PARTITION BY subject ORDER BY conf DESC, id) = 1),
 x AS (SELECT p.place_id, p.lon AS lon0, p.lat AS lat0, b.lon, b.lat, b.id, CASE WHEN p.score < 0 THEN 'fictional' WHEN p.score < 5000 THEN 'approximate' ELSE 'exact' END AS precision0 FROM {PLACES} p JOIN b ON b.subject = p.place_id)
 SELECT place_id, 'lon' AS field, CAST(CAST(round(lon0 * 1000000) AS BIGINT) AS VARCHAR) AS before, CAST(CAST(round(lon * 1000000) AS BIGINT) AS VARCHAR) AS after FROM x WHERE round(lon0, 6) <> round(lon, 6) UNION ALL SELECT place_id, 'lat', CAST(CAST(round(lat0 * 1000000) AS BIGINT) AS VARCHAR), CAST(CAST(round(lat * 1000000) AS BIGINT) AS VARCHAR) FROM x WHERE round(lat0, 6) <> round(lat, 6)
 UNION ALL SELECT place_id, 'precision', precision0, 'approximate' FROM x WHERE precision0 <> 'approximate' UNION ALL SELECT place_id, 'inferred_from', NULL, CAST(id AS VARCHAR) FROM x""")
def e16_diff(spark, d):
    """The approved inference of the highest confidence inside the bounds moves its place; a row for each field that changes."""
    ok = inferred(spark, d).filter((F.col("status") == "approved") & F.col("lon").between(113.9, 114.4) & F.col("lat").between(22.2, 22.5))
    b = ok.groupBy(F.col("subject").alias("place_id")).agg(F.max(F.struct("conf", (-F.col("id")).alias("back"), "id", "lon", "lat")).alias("b")).select("place_id", "b.id", F.col("b.lon").alias("lon1"), F.col("b.lat").alias("lat1"))
    x = places(spark, d).join(b, "place_id")
    precision = F.when(F.col("score") < 0, "fictional").when(F.col("score") < 5000, "approximate").otherwise("exact")
    micro = lambda c: F.round(F.col(c) * 1000000).cast("long").cast("string")
    change = lambda field, before, after: F.when(~before.eqNullSafe(after), F.struct(F.lit(field).alias("field"), before.alias("before"), after.alias("after")))
    fields = [change("lon", micro("lon"), micro("lon1")), change("lat", micro("lat"), micro("lat1")), change("precision", precision, F.lit("approximate")), change("inferred_from", F.lit(None).cast("string"), F.col("id").cast("string"))]
    return x.select("place_id", F.explode(F.array_compact(F.array(*fields))).alias("c")).select("place_id", "c.*")


_DECIDED = "(SELECT a, min(b) AS b FROM (SELECT greatest(x, y) AS a, least(x, y) AS b FROM (SELECT s_suppkey * 13 % (SELECT count(*) FROM customer) AS x, s_suppkey * 7 % (SELECT count(*) FROM customer) AS y FROM supplier WHERE s_acctbal > 2000) q WHERE x <> y) r GROUP BY a)"


@query("e18_decided_merges", f"""WITH RECURSIVE l AS MATERIALIZED (SELECT * FROM {_DECIDED} q), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), t AS (SELECT a, b AS root FROM r WHERE b NOT IN (SELECT a FROM l)),
 x AS (SELECT coalesce(root, place_id) AS target, n.* FROM {NAMED} n LEFT JOIN t ON a = place_id WHERE place_id < 100000000), c AS (SELECT target, list_sort(list(DISTINCT ch)) AS chapters FROM (SELECT target, unnest(chapters) AS ch FROM x) GROUP BY 1)
 SELECT x.target, list_sort(list(DISTINCT name)) AS aliases, any_value(coalesce(c.chapters, [])) AS chapters, count(*) AS merged FROM x LEFT JOIN c ON c.target = x.target GROUP BY x.target HAVING count(*) > 1""")
def e18_merges(spark, d):
    """Places merged by a table of decisions, along chains of them: names and chapters go into the last of each chain."""
    n = named(spark, d).filter("place_id < 100000000")
    total = read(spark, d, "customer").count()
    s = read(spark, d, "supplier").filter("s_acctbal > 2000").select((F.col("s_suppkey") * 13 % total).alias("x"), (F.col("s_suppkey") * 7 % total).alias("y")).filter("x <> y")
    links = s.groupBy(F.greatest("x", "y").alias("a")).agg(F.min(F.least("x", "y")).alias("b"))
    x = kept(n.join(gr.closure(links).withColumnRenamed("a", "place_id"), "place_id", "left").withColumn("target", F.coalesce("root", "place_id")), "merged")
    names = x.groupBy("target").agg(F.array_sort(F.collect_set("name")).alias("aliases"), F.count("*").alias("merged")).filter("merged > 1")
    ch = x.select("target", F.explode("chapters").alias("ch")).distinct().groupBy("target").agg(F.array_sort(F.collect_list("ch")).alias("chapters"))
    return names.join(ch, "target", "left").select("target", "aliases", F.coalesce("chapters", F.array().cast("array<bigint>")).alias("chapters"), "merged")


# moved places, and what refers to them: events with a place of their own, a timeline with a few dead ids, waypoints of routes
_MOVED = f"(SELECT place_id, name, round(lon + 0.01, 6) AS lon, round(lat, 6) AS lat FROM {PLACES} p WHERE score > 5000)"


@query("j28_dependents", f"""WITH m AS (SELECT * FROM {_MOVED} x) SELECT 'event' AS kind, o_orderkey AS id, m.place_id, [m.lon] AS lons FROM orders JOIN m ON m.place_id = o_custkey WHERE o_orderkey % 3 > 0 UNION ALL
 SELECT 'timeline', o_orderkey, coalesce(a.place_id, b.place_id), [] FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS ref, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS ref_name FROM orders) o LEFT JOIN m a ON a.place_id = ref LEFT JOIN m b ON a.place_id IS NULL AND b.name = ref_name WHERE coalesce(a.place_id, b.place_id) IS NOT NULL UNION ALL
 SELECT 'route', o_custkey, NULL, list(coalesce(m.lon, round(p.lon, 6)) ORDER BY o_orderkey) FROM orders JOIN {PLACES} p ON p.place_id = o_orderkey % 101 LEFT JOIN m ON m.place_id = p.place_id GROUP BY o_custkey HAVING count(m.place_id) > 0""")
def j28_all(spark, d):
    """Moved places carried into events (their own points), the timeline (ids; dead ones by name) and routes (each waypoint in order)."""
    p = places(spark, d)
    m = kept(p.filter("score > 5000").select("place_id", "name", F.round(F.col("lon") + 0.01, 6).alias("lon")), "moved")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    none = F.array().cast("array<double>")
    event = mt.salted(o.filter("o_orderkey % 3 > 0").withColumn("place_id", F.col("o_custkey")), m, ["place_id"], F.col("o_orderkey")).select(F.lit("event").alias("kind"), F.col("o_orderkey").alias("id"), "place_id", F.array("lon").alias("lons"))
    ref = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    t = o.select("o_orderkey", ref.alias("ref"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("ref_name"))
    t = mt.salted(t, m.select(F.col("place_id").alias("ref"), F.col("place_id").alias("by_id")), ["ref"], F.col("o_orderkey"), "left")
    t = mt.salted(t, m.groupBy(F.col("name").alias("ref_name")).agg(F.min("place_id").alias("by_name")), ["ref_name"], F.col("o_orderkey"), "left")
    t = t.select(F.lit("timeline").alias("kind"), F.col("o_orderkey").alias("id"), F.coalesce("by_id", "by_name").alias("place_id"), none.alias("lons")).filter("place_id is not null")
    own = p.select("place_id", F.round("lon", 6).alias("old")).join(m.select("place_id", F.col("lon").alias("new")), "place_id", "left")
    w = mt.salted(o.withColumn("place_id", F.col("o_orderkey") % 101), own, ["place_id"], F.col("o_orderkey"))
    r = w.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.coalesce("new", "old").alias("lon")))), lambda s: s["lon"]).alias("lons"), F.count("new").alias("n")).filter("n > 0")
    return event.union(t).union(r.select(F.lit("route").alias("kind"), F.col("o_custkey").alias("id"), F.lit(None).cast("long").alias("place_id"), "lons"))


_WAY = "(SELECT o_custkey AS entity, o_orderkey, o_orderkey % 200 AS chapter, o_custkey * 7 % 3000 + o_orderkey % 5 AS place_id FROM orders)"


@query("j34_routes", f"""WITH j AS (SELECT w.*, round(n.lon, 6) AS lon, round(n.lat, 6) AS lat FROM {_WAY} w LEFT JOIN {NAMED} n USING (place_id)), k AS (SELECT c_custkey AS entity FROM customer WHERE c_acctbal > -500),
 g AS (SELECT entity, count(*) AS n, count(lon) AS located, min(chapter) AS first_ch, max(chapter) AS last_ch, list_sort(list(DISTINCT chapter))[1:50] AS chapters, list([lon, lat] ORDER BY o_orderkey) FILTER (lon IS NOT NULL) AS points, list(place_id ORDER BY o_orderkey) FILTER (lon IS NULL) AS missing FROM j GROUP BY 1),
 s AS (SELECT g.*, CASE WHEN n < 2 THEN 'short' WHEN k.entity IS NULL THEN 'unknown' WHEN located < 2 THEN 'unlocated' ELSE 'ok' END AS reason FROM g LEFT JOIN k USING (entity))
 SELECT entity, reason, CASE WHEN reason = 'ok' THEN 'route_' || entity || '_' || row_number() OVER (PARTITION BY reason ORDER BY entity) END AS id, first_ch, last_ch, chapters, coalesce(points, []) AS points, coalesce(missing, []) AS missing FROM s""")
def j34_routes(spark, d):
    """Routes with their points in order, the places that have none, span and at most fifty chapters; those left out say why."""
    n = named(spark, d).select("place_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    w = read(spark, d, "orders").select(F.col("o_custkey").alias("entity"), "o_orderkey", (F.col("o_orderkey") % 200).alias("chapter"), (F.col("o_custkey") * 7 % 3000 + F.col("o_orderkey") % 5).alias("place_id"))
    j = mt.salted(w, n, ["place_id"], F.col("o_orderkey"), "left")
    at = lambda c, v: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("o_orderkey", v.alias("v"))))), lambda s: s["v"])
    found = F.col("lon").isNotNull()
    g = j.groupBy("entity").agg(
        F.count("*").alias("n"), F.count("lon").alias("located"), F.min("chapter").alias("first_ch"), F.max("chapter").alias("last_ch"), F.slice(F.array_sort(F.collect_set("chapter")), 1, 50).alias("chapters"),
        at(found, F.array("lon", "lat")).alias("points"), at(~found, F.col("place_id")).alias("missing"),
    )
    known = read(spark, d, "customer").filter("c_acctbal > -500").select(F.col("c_custkey").alias("entity"), F.lit(True).alias("known"))
    reason = F.when(F.col("n") < 2, "short").when(F.col("known").isNull(), "unknown").when(F.col("located") < 2, "unlocated").otherwise("ok")
    s = kept(g.join(known, "entity", "left").withColumn("reason", reason), "routes")
    ids = numbered(s.filter("reason = 'ok'").select("entity"), ["entity"]).select("entity", F.concat_ws("_", F.lit("route"), F.col("entity").cast("string"), F.col("number").cast("string")).alias("id"))
    return s.join(ids, "entity", "left").select("entity", "reason", "id", "first_ch", "last_ch", "chapters", "points", "missing")


_CHECKS = {"subject": "subject % 50 = 0", "status": "status NOT IN ('approved', 'pending')", "confidence": "conf < 0 OR conf > 0.9", "evidence": "evidence < 2", "lon": "lon NOT BETWEEN 113.9 AND 114.4", "lat": "lat NOT BETWEEN 22.2 AND 22.5"}


@query("q3_all_checks", " UNION ALL ".join(f"SELECT id, '{k}' AS problem FROM {INFERRED} i WHERE {c}" for k, c in _CHECKS.items()))
def q3_all(spark, d):
    """Inferences that break a rule, a row for each: subject, status, confidence, evidence, box."""
    found = [F.when(F.expr(c), k) for k, c in _CHECKS.items()]
    return inferred(spark, d).select("id", F.explode(F.array_compact(F.array(*found))).alias("problem"))


@query("q5_manifest", "WITH m AS (SELECT n_name AS dataset, CAST(floor(n_regionkey * 10 + 55) AS BIGINT) AS declared FROM nation WHERE n_nationkey % 6 <> 5), a AS (SELECT n_name AS dataset, count(*) AS actual FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 7 <> 6 GROUP BY 1) SELECT dataset, declared, actual, CASE WHEN declared IS NULL THEN 'undeclared' WHEN actual IS NULL THEN 'absent' WHEN declared = actual THEN 'ok' ELSE 'differs' END AS verdict FROM m FULL JOIN a USING (dataset)")
def q5_manifest(spark, d):
    """Declared counts against actual ones; datasets that either side lacks are named."""
    n = read(spark, d, "nation")
    m = n.filter("n_nationkey % 6 <> 5").select(F.col("n_name").alias("dataset"), (F.col("n_regionkey") * 10 + 55).cast("long").alias("declared"))
    counts = read(spark, d, "customer").filter("c_nationkey % 7 <> 6").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("actual"))
    a = counts.join(n, "n_nationkey").select(F.col("n_name").alias("dataset"), "actual")
    verdict = F.when(F.col("declared").isNull(), "undeclared").when(F.col("actual").isNull(), "absent").when(F.col("declared") == F.col("actual"), "ok").otherwise("differs")
    return m.join(a, "dataset", "full").select("dataset", "declared", "actual", verdict.alias("verdict"))


_STATUS = "CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'needs_review' END"
_LINES = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber, l_discount * 10 AS conf, " + _STATUS + " AS status, l_tax * 20 AS x, CAST(l_quantity AS INTEGER) % 5 AS spoiler, l_shipdate FROM lineitem)"
_ROWS = {"status": "(conf >= 0.5) <> (status = 'approved')", "position": "x < 0 OR x > 1", "spoiler": "spoiler > 3"}


@query("q7_all_checks", "SELECT 'duplicate' AS problem, id FROM (SELECT id FROM " + _LINES + " l GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'pronoun', p_partkey FROM part WHERE split_part(p_name, ' ', 1) IN ('old', 'new') UNION ALL SELECT 'long', p_partkey FROM part WHERE length(p_name) > 9 UNION ALL SELECT 'span', o_custkey FROM (SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS span FROM orders GROUP BY 1) WHERE span > 400000 UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', id FROM {_LINES} l WHERE {c}" for k, c in _ROWS.items()))
def q7_all(spark, d):
    """Ids that occur twice, words that may not stand for a name, texts beyond their limit, groups beyond their span, and rows whose
    status, position or level breaks its rule."""
    status = F.when(F.col("l_linestatus") == "F", "approved").otherwise("needs_review")
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 10).alias("conf"), status.alias("status"), (F.col("l_tax") * 20).alias("x"), (F.col("l_quantity").cast("int") % 5).alias("spoiler"))
    rows = x.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(c), k) for k, c in _ROWS.items()]))).alias("problem"), "id")
    twice = x.groupBy("id").count().filter("count > 1").select(F.lit("duplicate").alias("problem"), "id")
    p = read(spark, d, "part")
    pronoun = p.filter(F.substring_index("p_name", " ", 1).isin("old", "new")).select(F.lit("pronoun"), "p_partkey")
    long = p.filter(F.length("p_name") > 9).select(F.lit("long"), "p_partkey")
    span = read(spark, d, "orders").groupBy("o_custkey").agg((F.max("o_totalprice") - F.min("o_totalprice")).alias("span")).filter("span > 400000").select(F.lit("span"), "o_custkey")
    return twice.union(pronoun).union(long).union(span).union(rows)


# tiers of a map: the box of each kind of place in each nation, one for all, and some that come twice
TIERS = f"(SELECT 'all' AS id, min(lon) AS lo, max(lon) AS hi, min(lat) AS la, max(lat) AS ha FROM {PLACES} p WHERE seg <> 'MACHINERY' UNION ALL SELECT seg || nation, min(lon), max(lon), min(lat), max(lat) FROM {PLACES} p GROUP BY seg, nation UNION ALL SELECT CASE WHEN nation < 3 THEN 'BUILDING' || nation ELSE 'copy' || nation END, min(lon), max(lon), min(lat), max(lat) FROM {PLACES} p WHERE seg = 'BUILDING' AND nation < 6 GROUP BY nation)"


@query("q8_tier_checks", f"""WITH t AS (SELECT * FROM {TIERS} x), o AS (SELECT * FROM t WHERE id = 'all'), v AS (SELECT lon - 0.01 AS vlo, lon + 0.01 AS vhi, lat - 0.005 AS vla, lat + 0.005 AS vha FROM {PLACES} p)
 SELECT DISTINCT 'outside' AS problem, t.id FROM t, o WHERE t.lo < o.lo OR t.hi > o.hi OR t.la < o.la OR t.ha > o.ha UNION ALL SELECT DISTINCT 'wider', t.id FROM t, o WHERE t.hi - t.lo > o.hi - o.lo UNION ALL SELECT 'twice', id FROM t GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT DISTINCT 'equal', id FROM (SELECT id, count(*) OVER (PARTITION BY lo, hi, la, ha) AS n FROM t) WHERE n > 1 UNION ALL SELECT DISTINCT 'narrow', id FROM t WHERE hi - lo < 0.02
 UNION ALL SELECT DISTINCT 'unreachable', id FROM t WHERE id NOT IN (SELECT arg_min(id, {{'w': hi - lo, 'i': id}}) FROM (SELECT row_number() OVER () AS r, * FROM v) v JOIN t ON lo <= vlo AND hi >= vhi AND la <= vla AND ha >= vha GROUP BY r)""")
def q8_all(spark, d):
    """Tiers outside the overview or wider, ids that come twice, equal boxes, tiers narrower than the narrowest view, and tiers
    that no view picks as its narrowest cover."""
    p = kept(places(spark, d).select("seg", "nation", "lon", "lat"), "places")
    box = [F.min("lon").alias("lo"), F.max("lon").alias("hi"), F.min("lat").alias("la"), F.max("lat").alias("ha")]
    name = F.concat("seg", F.col("nation").cast("string"))
    copy = F.concat(F.when(F.col("nation") < 3, "BUILDING").otherwise("copy"), F.col("nation").cast("string"))
    t = p.filter("seg <> 'MACHINERY'").agg(*box).select(F.lit("all").alias("id"), "lo", "hi", "la", "ha")
    t = t.union(p.groupBy(name.alias("id")).agg(*box)).union(p.filter("seg = 'BUILDING' and nation < 6").groupBy(copy.alias("id")).agg(*box))
    t = kept(t, "tiers")
    o = t.filter("id = 'all'").select(F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.col("la").alias("ola"), F.col("ha").alias("oha"))
    wide = t.join(F.broadcast(o)).select("id", F.explode(F.array_compact(F.array(F.when(F.expr("lo < olo or hi > ohi or la < ola or ha > oha"), "outside"), F.when(F.expr("hi - lo > ohi - olo"), "wider"), F.when(F.expr("hi - lo < 0.02"), "narrow")))).alias("problem"))  # one overview
    twice = t.groupBy("id").count().filter("count > 1").select(F.lit("twice").alias("problem"), "id")
    same = t.groupBy("lo", "hi", "la", "ha").agg(F.collect_set("id").alias("ids"), F.count("*").alias("n")).filter("n > 1").select(F.lit("equal"), F.explode("ids"))
    v = p.select((F.col("lon") - 0.01).alias("vlo"), (F.col("lon") + 0.01).alias("vhi"), (F.col("lat") - 0.005).alias("vla"), (F.col("lat") + 0.005).alias("vha")).distinct()
    # a view and the tiers that cover it share the cell of the view's corner; tiers are dealt to the cells they cover
    cell = 0.05
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    dealt = t.withColumn("cx", span("lo", "hi")).withColumn("cy", span("la", "ha"))
    met = v.withColumn("cx", F.floor(F.col("vlo") / cell)).withColumn("cy", F.floor(F.col("vla") / cell)).join(dealt, ["cx", "cy"]).filter("lo <= vlo and hi >= vhi and la <= vla and ha >= vha")
    picked = met.groupBy("vlo", "vla").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "id")).alias("m")).select("m.id").distinct()
    never = t.select("id").distinct().join(picked, "id", "left_anti").select(F.lit("unreachable"), "id")
    return wide.select("problem", "id").distinct().union(twice).union(same.distinct()).union(never)
