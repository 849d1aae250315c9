"""Queries: order of a timeline, periods against entries, chapter boxes, totals, notes in names."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.functions import names as nm
from placeweave.operators import match as mt
from placeweave.operators.graph import kept
from placeweave.operators.numbering import numbered

from .base import query, read
from .zones import NAMED, named

# a timeline: orders in the order of their keys, most with a sort key of their month, the others by a chapter
_LINE = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 > 0 THEN 'ch' || lpad(CAST(month(o_orderdate) AS VARCHAR), 3, '0') END AS given, 'ch' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 3, '0') AS other FROM orders)"


@query("a23_sorted_timeline", f"""WITH t AS (SELECT *, coalesce(given, other) AS k, row_number() OVER (ORDER BY id) AS a FROM {_LINE} x), s AS (SELECT *, row_number() OVER (ORDER BY k, a) AS b FROM t),
 x AS (SELECT given > lead(given) OVER (ORDER BY a) AS inv FROM s WHERE given IS NOT NULL), y AS (SELECT given > lead(given) OVER (ORDER BY b) AS inv FROM s WHERE given IS NOT NULL)
 SELECT (SELECT count(*) FROM x WHERE inv) AS inversions_before, (SELECT count(*) FROM y WHERE inv) AS inversions_after, (SELECT count(*) FROM s WHERE a <> b) AS moved, (SELECT count(*) FROM s) AS n""")
def a23_sorted(spark, d):
    """Neighbours of a timeline out of order before and after a stable sort, and rows whose place changes. Places are
    numbers, and neighbours meet by number."""
    o = read(spark, d, "orders")
    given = F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("ch"), F.lpad(F.month("o_orderdate").cast("string"), 3, "0")))
    t = o.select(F.col("o_orderkey").alias("id"), given.alias("given"), nm.sort_key(given, F.col("o_orderkey") % 12 + 1).alias("k"))
    s = kept(numbered(numbered(t, ["id"], name="a"), ["k", "a"], name="b"), "timeline")

    def inversions(at: str):
        own = kept(numbered(s.filter("given is not null").select("given", at), [at], name="n").select("given", "n"), "order")
        nxt = own.select((F.col("n") - 1).alias("n"), F.col("given").alias("later"))
        return own.join(nxt, "n").agg(F.count_if(F.col("given") > F.col("later")).alias("inversions_" + ("before" if at == "a" else "after")))

    total = s.agg(F.count_if(F.col("a") != F.col("b")).alias("moved"), F.count("*").alias("n"))
    return inversions("a").join(inversions("b")).join(total)  # one row each


_BOUNDS = "(SELECT n_nationkey AS ord, n_name AS period, n_nationkey * 7 - CASE WHEN n_nationkey % 4 = 1 THEN 3 ELSE 0 END AS lo, n_nationkey * 7 + 5 - CASE WHEN n_nationkey % 9 = 8 THEN 20 ELSE 0 END AS hi FROM nation)"


@query("a24_boundary_checks", f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM {_BOUNDS} x), w(i, upto, period, verdict) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) UNION ALL
  SELECT b.i, CASE WHEN lo <= hi AND lo >= upto THEN hi ELSE upto END, b.period, CASE WHEN lo > hi THEN 'reversed' WHEN lo < upto THEN 'overlap' ELSE 'ok' END FROM w JOIN b ON b.i = w.i + 1),
 e AS (SELECT n_name AS period, c_custkey % 180 AS ch FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0)
 SELECT w.period, verdict, count(ch) AS entries, count(*) FILTER (ch BETWEEN lo AND hi) AS inside FROM w JOIN b ON b.period = w.period LEFT JOIN e ON e.period = w.period GROUP BY 1, 2""")
def a24_checks(spark, d):
    """Suggested periods in order: reversed ones, ones that begin before the last sound one ends, and how many of a period's
    entries lie inside it. Periods are a small list, folded in a row; entries only meet them as counts."""
    k = F.col("n_nationkey")
    b = read(spark, d, "nation").select(k.alias("ord"), F.col("n_name").alias("period"), (k * 7 - F.when(k % 4 == 1, 3).otherwise(0)).cast("long").alias("lo"), (k * 7 + 5 - F.when(k % 9 == 8, 20).otherwise(0)).cast("long").alias("hi"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<struct<period:string,verdict:string>>").alias("out"))

    def step(w, x):
        sound = (x["lo"] <= x["hi"]) & (x["lo"] >= w["upto"])
        verdict = F.when(x["lo"] > x["hi"], "reversed").when(x["lo"] < w["upto"], "overlap").otherwise("ok")
        return F.struct(F.when(sound, x["hi"]).otherwise(w["upto"]).alias("upto"), F.array_append(w["out"], F.struct(x["period"].alias("period"), verdict.alias("verdict"))).alias("out"))

    fold = b.agg(F.array_sort(F.collect_list(F.struct("ord", "period", "lo", "hi"))).alias("b")).select(F.explode(F.aggregate("b", start, step, lambda w: w["out"])).alias("v")).select("v.*")
    per = read(spark, d, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("ord"), (F.col("c_custkey") % 180).alias("ch")).agg(F.count("*").alias("n"))
    counts = per.join(mt.sized(b), "ord").groupBy("period").agg(F.sum("n").alias("entries"), F.sum(F.when(F.col("ch").between(F.col("lo"), F.col("hi")), F.col("n")).otherwise(0)).alias("inside"))
    return fold.join(counts, "period", "left").select("period", "verdict", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("inside", F.lit(0)).alias("inside"))


def _side(lo: str, hi: str, low: float, high: float) -> tuple[str, str]:
    pad = f"greatest({hi} - {lo}, 0.02) * 0.25"
    grow = f"greatest(0, 0.02 - ({hi} - {lo})) / 2"
    return f"greatest({low}, {lo} - {grow} - {pad})", f"least({high}, {hi} + {grow} + {pad})"


_X, _Y = _side("lo", "hi", 113.85, 114.45), _side("la", "ha", 22.18, 22.55)


@query("a28_viewports", f"WITH c AS (SELECT DISTINCT o_orderkey % 200 AS cur FROM orders), p AS (SELECT DISTINCT place_id, lon, lat, unnest(chapters) AS ch FROM {NAMED} n WHERE NOT fictional), b AS (SELECT cur, min(lon) AS lo, max(lon) AS hi, min(lat) AS la, max(lat) AS ha FROM c JOIN p ON abs(ch - cur) <= 2 GROUP BY 1) SELECT cur, round({_X[0]}, 6) AS lo, round({_X[1]}, 6) AS hi, round({_Y[0]}, 6) AS la, round({_Y[1]}, 6) AS ha FROM b")
def a28_viewports(spark, d):
    """The box of each chapter and the two around it: at least a span on both sides, a quarter more as a margin, cut at the map's
    border. Boxes of single chapters meet, not places."""
    cur = read(spark, d, "orders").select((F.col("o_orderkey") % 200).alias("cur")).distinct()
    one = named(spark, d).filter("not fictional").select("lon", "lat", F.explode("chapters").alias("ch")).groupBy("ch").agg(F.min("lon").alias("lo"), F.max("lon").alias("hi"), F.min("lat").alias("la"), F.max("lat").alias("ha"))
    wide = cur.withColumn("ch", F.explode(F.sequence(F.col("cur") - 2, F.col("cur") + 2))).join(one, "ch")
    b = wide.groupBy("cur").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("la").alias("la"), F.max("ha").alias("ha"))
    return b.select("cur", *[F.round(F.expr(e), 6).alias(n) for n, e in zip(("lo", "hi", "la", "ha"), (*_X, *_Y))])


@query("a33_all_totals", "WITH e AS (SELECT o_custkey AS entry, min(month(o_orderdate)) AS first_ch, bool_or(o_orderstatus = 'P' AND month(o_orderdate) < 4) AS flashback, bool_or(o_totalprice > 400000) AS located FROM orders GROUP BY 1), r AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b FROM lineitem WHERE l_suppkey <> l_partkey % 100) SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM e WHERE flashback) AS flashbacks, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM e WHERE located) AS located")
def a33_all(spark, d):
    """Entries, flashbacks among them, distinct related pairs, and entries with a place."""
    m = F.month("o_orderdate")
    e = read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or((F.col("o_orderstatus") == "P") & (m < 4)).alias("flashback"), F.bool_or(F.col("o_totalprice") > 400000).alias("located"))
    other = F.col("l_partkey") % 100
    r = read(spark, d, "lineitem").filter(F.col("l_suppkey") != other).select(F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b")).distinct().agg(F.count("*").alias("relations"))
    t = e.agg(F.count("*").alias("entries"), F.count_if("flashback").alias("flashbacks"), F.count_if("located").alias("located"))
    return t.join(r).select("entries", "flashbacks", "relations", "located")  # one row each


_NOTED = "(SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '（' || p_brand || '）' WHEN 2 THEN p_name || ' (' || p_type || ')' ELSE upper(p_name) END AS name, CASE WHEN p_size < 10 THEN [p_type] ELSE [] END AS aliases FROM part)"


@query("e1_parenthetical_merge", f"WITH s AS (SELECT CASE WHEN regexp_matches(name, '^(.+?)[（(](.+?)[）)]$') THEN trim(regexp_extract(name, '^(.+?)[（(](.+?)[）)]$', 1)) ELSE name END AS name, CASE WHEN regexp_matches(name, '^(.+?)[（(](.+?)[）)]$') THEN list_append(aliases, regexp_extract(name, '^(.+?)[（(](.+?)[）)]$', 2)) ELSE aliases END AS aliases FROM {_NOTED} n), x AS (SELECT name, unnest(aliases) AS alias FROM s) SELECT s.name, coalesce(any_value(a.aliases), []) AS aliases, count(*) AS n FROM s LEFT JOIN (SELECT name, list_sort(list(DISTINCT alias)) AS aliases FROM x GROUP BY 1) a ON a.name = s.name GROUP BY 1")
def e1_notes(spark, d):
    """A note in brackets behind a name becomes an alias of the name."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("（"), "p_brand", F.lit("）"))).when(k == 2, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.upper("p_name"))
    p = read(spark, d, "part").select(name.alias("given"), F.when(F.col("p_size") < 10, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("own"))
    plain, note = nm.strip_note(F.col("given"))
    s = p.select(plain.alias("name"), F.when(note != "", F.array_append("own", note)).otherwise(F.col("own")).alias("own"))
    each = s.select("name", F.explode("own").alias("alias")).distinct().groupBy("name").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return s.groupBy("name").agg(F.count("*").alias("n")).join(each, "name", "left").select("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "n")
