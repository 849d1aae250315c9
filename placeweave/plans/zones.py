"""Queries: zones from place names, their merge, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.operators import anchoring as an
from placeweave.operators import greedy
from placeweave.operators import zones as zn
from placeweave.operators.graph import kept

from .base import PLACES, hash_point, metres, places, query, read, sql_metres, sql_point

RULES = zn.ZoneRules(words=(("ring", "camp"), ("gear", "nest"), ("plate", "camp")), locatives=("within", "below"), radius={"camp": 300.0, "nest": 150.0})
GAP_LON, GAP_LAT = 3000 / (0.9248 * 111320.0), 3000 / 110570.0

# Places with zone words: a customer's name from its part and nation, some of them a part of a zone; a supplier's names
# one in brackets. A customer's chapters come from its orders.
_PART = "JOIN part ON p_partkey ="
NAMED = f"""(SELECT c_custkey AS place_id, split_part(p_name, ' ', 1) || ' ' || c_nationkey || ' ' || split_part(p_name, ' ', 2) || CASE c_custkey % 3 WHEN 0 THEN ' wall' ELSE '' END AS name, c_acctbal < 0 AS fictional,
 {sql_point('c_name')}, coalesce(ch, []) AS chapters FROM customer {_PART} c_custkey LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderkey % 200) AS ch FROM orders GROUP BY 1) o ON o_custkey = c_custkey
 UNION ALL SELECT 100000000 + s_suppkey, 'gate (' || split_part(p_name, ' ', 1) || ' ' || s_suppkey % 25 || ' ' || split_part(p_name, ' ', 2) || ' within)', s_acctbal < 0, {sql_point('s_name')}, [s_suppkey % 200] FROM supplier {_PART} s_suppkey)"""


def named(spark, d):
    """place_id, name, fictional, lon, lat, chapters."""
    part = read(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("head"), F.substring_index("p_name", " ", -1).alias("tail"))
    ch = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("place_id")).agg(F.collect_set(F.col("o_orderkey") % 200).alias("chapters"))
    lon, lat = hash_point(F.col("c_name"))
    wall = F.when(F.col("c_custkey") % 3 == 0, " wall").otherwise("")
    c = read(spark, d, "customer").join(part, F.col("p_partkey") == F.col("c_custkey"))
    c = c.select(F.col("c_custkey").alias("place_id"), F.concat("head", F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" "), "tail", wall).alias("name"), (F.col("c_acctbal") < 0).alias("fictional"), lon.alias("lon"), lat.alias("lat"))
    c = c.join(ch, "place_id", "left").withColumn("chapters", F.coalesce("chapters", F.array().cast("array<bigint>")))
    lon, lat = hash_point(F.col("s_name"))
    inner = F.concat(F.lit("gate ("), "head", F.lit(" "), (F.col("s_suppkey") % 25).cast("string"), F.lit(" "), "tail", F.lit(" within)"))
    s = read(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey"))
    s = s.select((F.col("s_suppkey") + 100000000).alias("place_id"), inner.alias("name"), (F.col("s_acctbal") < 0).alias("fictional"), lon.alias("lon"), lat.alias("lat"), F.array(F.col("s_suppkey") % 200).alias("chapters"))
    return c.unionByName(s)


# the same rules in SQL: seed, members, shape
_CUT = "CASE WHEN regexp_extract(name, '[(]([^)]*)[)]', 1) SIMILAR TO '.*(ring|gear|plate).*' AND regexp_extract(name, '[(]([^)]*)[)]', 1) SIMILAR TO '.*(within|below).*' THEN NULL "
_CUT += " ".join(f"WHEN contains(name, '{w}') THEN CASE WHEN instr(name, '{w}') - 1 + {len(w)} > {len(w)} + 1 THEN substr(name, 1, instr(name, '{w}') - 1 + {len(w)}) END" for w, _ in RULES.words) + " END"
MEMBERS = f"""(WITH p AS (SELECT place_id, name, {_CUT} AS zone FROM {NAMED} n), f AS (SELECT zone, min(place_id) AS first FROM p WHERE zone IS NOT NULL GROUP BY 1)
 SELECT place_id, zone, 0 AS assigned FROM p WHERE zone IS NOT NULL UNION ALL SELECT place_id, arg_min(f.zone, first), 1 FROM p JOIN f ON p.zone IS NULL AND contains(name, f.zone) GROUP BY place_id)"""
_RADIUS = "CASE WHEN contains(zone, 'ring') THEN 300 WHEN contains(zone, 'gear') THEN 150 ELSE 300 END"


def _shapes(member: str, radius: str, order: str) -> str:
    return f"""(WITH x AS (SELECT m.*, n.name, n.fictional, n.lon, n.lat, n.chapters FROM {member} m JOIN {NAMED} n USING (place_id)),
 g AS (SELECT zone, min(place_id) AS first, count(*) AS n, count(*) FILTER (NOT fictional) AS located, avg(lon) FILTER (NOT fictional) AS lon_c, avg(lat) FILTER (NOT fictional) AS lat_c, arg_min(lon, {order}) AS lon_1, arg_min(lat, {order}) AS lat_1,
  arg_min(name, {{'l': length(name), 'o': {order}}}) AS body FROM x GROUP BY zone),
 c AS (SELECT *, CASE WHEN located >= 2 THEN lon_c ELSE lon_1 END AS lon, CASE WHEN located >= 2 THEN lat_c ELSE lat_1 END AS lat FROM g),
 r AS (SELECT x.zone, max({sql_metres('x', 'c')}) AS far FROM x JOIN c ON c.zone = x.zone WHERE NOT fictional GROUP BY 1),
 h AS (SELECT zone, list_sort(list(DISTINCT ch)) AS chapters FROM (SELECT zone, unnest(chapters) AS ch FROM x) GROUP BY 1)
 SELECT c.zone, first, lon, lat, least(2000, greatest(80, CASE WHEN located >= 2 THEN far * 1.15 ELSE {radius} END)) AS radius, CASE WHEN located >= 2 THEN 'members' ELSE 'default' END AS source, n, located, coalesce(chapters, [])[1:50] AS chapters, body
 FROM c LEFT JOIN r ON r.zone = c.zone LEFT JOIN h ON h.zone = c.zone)"""


SHAPES = _shapes(MEMBERS, _RADIUS.replace("zone", "c.zone"), "{'a': assigned, 'p': place_id}")


@query("a11_zone_members", f"SELECT place_id, zone, assigned FROM {MEMBERS} m")
def a11_members(spark, d):
    return zn.members(named(spark, d), RULES)


def shapes(spark, d):
    places = kept(named(spark, d), "places")
    member = kept(zn.members(places, RULES), "members")
    return places, member, kept(zn.shapes(member, places, RULES, metres, zn.kind_radius(RULES)), "zones")


_ROUNDED = "round(lon, 6) AS lon, round(lat, 6) AS lat, round(radius, 1) AS radius, source, n, located, chapters, body"


@query("a11_zone_shapes", f"SELECT zone, {_ROUNDED} FROM {SHAPES} s")
def a11_shapes(spark, d):
    return shapes(spark, d)[2].select("zone", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("radius", 1).alias("radius"), "source", "n", "located", "chapters", "body")


_FIRST_END = "list_min(list_filter([" + ", ".join(f"CASE WHEN contains(zone, '{w}') THEN instr(zone, '{w}') + {len(w) - 1} END" for w, _ in RULES.words) + "], lambda e: e IS NOT NULL))"
# the walk itself, a zone at a time: those it takes leave the free ones
WALK = f"""(WITH RECURSIVE z AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first) AS i, substr(zone, 1, coalesce({_FIRST_END}, 0)) AS cut FROM {SHAPES} s),
 e AS MATERIALIZED (SELECT a.i, list(b.i) AS later FROM z a JOIN z b ON a.i < b.i AND substr(a.zone, 1, 2) = substr(b.zone, 1, 2) AND (a.cut = '' OR a.cut <> b.cut) AND {sql_metres('a', 'b')} <= 3000 GROUP BY 1),
 w(i, used, own) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
  SELECT w.i + 1, CASE WHEN list_contains(used, w.i + 1) THEN used ELSE list_concat(used, list_filter(coalesce(later, []), lambda j: NOT list_contains(used, j))) END,
   CASE WHEN list_contains(used, w.i + 1) THEN [] ELSE list_append(list_filter(coalesce(later, []), lambda j: NOT list_contains(used, j)), w.i + 1) END
  FROM w LEFT JOIN e ON e.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM z)),
 m AS (SELECT i, unnest(own) AS j FROM w) SELECT b.zone, a.zone AS centre FROM m JOIN z a ON a.i = m.i JOIN z b ON b.i = m.j)"""
_GROUPED = f"(SELECT place_id, centre AS zone, {{'f': first, 'a': assigned}} AS assigned FROM {MEMBERS} m JOIN {WALK} k ON k.zone = m.zone JOIN (SELECT zone AS z, first FROM {SHAPES} s) s ON s.z = m.zone WHERE centre IN (SELECT centre FROM {WALK} q GROUP BY 1 HAVING count(*) > 1))"
_BOTH = f"(SELECT * FROM {_shapes(_GROUPED, '300', '{''a'': assigned, ''p'': place_id}'.replace(chr(39) * 2, chr(39)))} a UNION ALL SELECT * FROM {SHAPES} b WHERE zone IN (SELECT centre FROM {WALK} q GROUP BY 1 HAVING count(*) = 1))"


@query("a12_zone_star", f"WITH g AS (SELECT centre, count(*) AS zones, arg_min(k.zone, {{'l': length(k.zone), 'f': first}}) AS name FROM {WALK} k JOIN {SHAPES} s ON s.zone = k.zone GROUP BY 1) SELECT g.centre, g.name, g.zones, {_ROUNDED} FROM g JOIN {_BOTH} b ON b.zone = g.centre")
def a12_star(spark, d):
    places, member, zones = shapes(spark, d)
    merged = kept(zn.merges(zones, RULES, metres, GAP_LON, GAP_LAT), "merged")
    out = zn.merged_shapes(zones, member, places, merged, RULES, metres)
    return out.select("centre", "name", "zones", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("radius", 1).alias("radius"), "source", "n", "located", "chapters", "body")


# labels of one name, the more important ones first, then from south to north and west to east
_SPOTS = f"(SELECT seg, place_id, lon, lat, row_number() OVER (PARTITION BY seg ORDER BY nation % 2, lat, lon, place_id) AS rn FROM {PLACES} p)"


def _thinned(most: int) -> str:
    free = "len(list_filter(own, lambda p: (c.lon - p.x) * (c.lon - p.x) + (c.lat - p.y) * (c.lat - p.y) < CAST(0.1 AS DOUBLE) * CAST(0.1 AS DOUBLE))) = 0"
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {_SPOTS} s), w(seg, rn, own) AS (SELECT DISTINCT seg, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) FROM c UNION ALL
 SELECT c.seg, c.rn, CASE WHEN len(own) < {most} AND {free} THEN list_append(own, {{'id': c.place_id, 'x': c.lon, 'y': c.lat}}) ELSE own END FROM w JOIN c ON c.seg = w.seg AND c.rn = w.rn + 1)
 SELECT seg, unnest(arg_max(own, rn)).id AS place_id FROM w GROUP BY seg"""


def _spots(spark, d):
    rank = F.struct((F.col("nation") % 2).alias("minor"), "lat", "lon", "place_id")
    return places(spark, d).select(F.col("seg").alias("name"), rank.alias("rank"), F.col("lon").alias("x"), F.col("lat").alias("y"))


@query("w9_name_thinning", _thinned(3))
def w9(spark, d):
    """At most three labels of a name, each at least a spacing away from the name's earlier ones."""
    return greedy.spaced(_spots(spark, d), 0.1, 3).select(F.col("name").alias("seg"), "rank.place_id")


@query("w9_all_spaced", _thinned(1_000_000))
def w9_all(spark, d):
    """As many labels of a name as the spacing leaves room for."""
    return greedy.spaced(_spots(spark, d), 0.1, 1_000_000).select(F.col("name").alias("seg"), "rank.place_id")


# what is told of a place: where a second one is; every third has no such tale
_TOLD = f"(SELECT n.*, CASE n.place_id % 3 WHEN 0 THEN 'stands within ' || q.name || ' by the road' WHEN 1 THEN 'seen far from ' || q.name || ', says a guide' ELSE 'nothing is known' END AS description, CASE n.place_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' ELSE 'district' END AS precision FROM {NAMED} n LEFT JOIN {NAMED} q ON q.place_id = n.place_id // 2 + 1)"
_LONGEST = "{'l': length(parent), 'r': -rank}"
_SURE, _BESIDE = 13, 8


def told(spark, d):
    n = kept(named(spark, d), "named")
    q = n.select(F.col("place_id").alias("second"), F.col("name").alias("other"))
    n = n.withColumn("second", F.floor(F.col("place_id") / 2) + 1).join(q, "second", "left")
    k = F.col("place_id") % 3
    tale = F.when(k == 0, F.concat(F.lit("stands within "), "other", F.lit(" by the road"))).when(k == 1, F.concat(F.lit("seen far from "), "other", F.lit(", says a guide"))).otherwise("nothing is known")
    return n.drop("second").withColumn("description", tale).withColumn("precision", F.when(k == 0, "exact").when(k == 1, "approximate").otherwise("district"))


_H = "CAST('0x' || substr(sha1(CAST(place_id AS VARCHAR)), 1, 8) AS BIGINT)"
_R = f"(CASE WHEN parent IS NOT NULL THEN 90 ELSE 420 END * (0.45 + 0.55 * (({_H} >> 12) % 1000) / 1000))"
_ANGLE = f"({_H} % 3600 / 3600::DOUBLE * (2 * pi()))"


@query("e20_ring_anchoring", f"""WITH t AS MATERIALIZED (SELECT * FROM {_TOLD} x), l AS (SELECT * FROM t WHERE fictional), r AS (SELECT * FROM t WHERE NOT fictional), n AS (SELECT name AS parent, min(place_id) AS rank, arg_min(lon, place_id) AS plon, arg_min(lat, place_id) AS plat, arg_min(precision, place_id) AS pprec FROM r GROUP BY 1),
 a AS (SELECT place_id, arg_max(parent, {_LONGEST}) AS parent, 'name' AS via FROM l JOIN n ON length(parent) >= 3 AND contains(name, parent) AND parent <> name GROUP BY 1),
 b AS (SELECT place_id, arg_max(parent, {_LONGEST}) AS parent, 'description' AS via FROM (SELECT l.place_id, parent, rank, description, instr(description, parent) AS p FROM l JOIN n ON length(parent) >= 2 AND contains(description, parent) WHERE place_id NOT IN (SELECT place_id FROM a)) x
  WHERE length(parent) >= {_SURE} OR contains(substr(description, greatest(1, p - {_BESIDE}), p + length(parent) + {_BESIDE} - greatest(1, p - {_BESIDE})), 'within') GROUP BY 1),
 c AS (SELECT unnest(chapters) AS ch, lon, lat FROM r WHERE lon BETWEEN 114.0 AND 114.3 AND lat BETWEEN 22.25 AND 22.45), m AS (SELECT place_id, avg(c.lon) AS mx, avg(c.lat) AS my FROM (SELECT place_id, unnest(chapters) AS ch FROM l) x JOIN c USING (ch) GROUP BY 1),
 j AS (SELECT l.place_id, f.parent, via, plon, plat, pprec, mx, my FROM l LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) f USING (place_id) LEFT JOIN n USING (parent) LEFT JOIN m USING (place_id))
 SELECT place_id, CASE WHEN parent IS NOT NULL THEN 'parent-' || via WHEN mx IS NOT NULL THEN 'chapter' ELSE 'default' END AS source, parent, coalesce(pprec, 'fictional') AS precision,
 round(coalesce(plon, mx, 114.2) + {_R} * cos({_ANGLE}) / (0.9248 * 111320.0), 6) AS lon, round(coalesce(plat, my, 22.3) + {_R} * sin({_ANGLE}) / 110570.0, 6) AS lat FROM j""")
def e20_rings(spark, d):
    """Fictional places beside their parent, else round the middle of their chapters' places, else round a centre."""
    t = kept(told(spark, d), "told")
    region = F.col("lon").between(114.0, 114.3) & F.col("lat").between(22.25, 22.45)
    out = an.anchored(t.filter("fictional"), t.filter("not fictional"), region, (114.2, 22.3), 0.9248 * 111320.0, 110570.0, sure=_SURE, cues=("within",), near=_BESIDE)
    return out.select("place_id", "source", "parent", "precision", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_PARENT = f"(SELECT name AS parent, min(place_id) AS rank FROM {NAMED} n WHERE NOT fictional GROUP BY 1)"


@query("j12_parents", f"""WITH t AS MATERIALIZED (SELECT * FROM {_TOLD} x), n AS (SELECT * FROM {_PARENT} y), a AS (SELECT place_id, arg_max(parent, {_LONGEST}) AS parent, 'name' AS via FROM t JOIN n ON length(parent) >= 3 AND contains(name, parent) AND parent <> name GROUP BY 1),
 b AS (SELECT place_id, arg_max(parent, {_LONGEST}) AS parent, 'description' AS via FROM (SELECT place_id, parent, rank, description, instr(description, parent) AS p FROM t JOIN n ON contains(description, parent) WHERE place_id NOT IN (SELECT place_id FROM a)) x
  WHERE length(parent) >= {_SURE} OR contains(substr(description, greatest(1, p - {_BESIDE}), p + length(parent) + {_BESIDE} - greatest(1, p - {_BESIDE})), 'within') GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b""")
def j12_parents(spark, d):
    """The known place that holds another: by its name, else by its description."""
    t = kept(told(spark, d), "told")
    known = t.filter("not fictional").groupBy("name").agg(F.min("place_id").alias("rank"))
    return an.parents(t, known, sure=_SURE, cues=("within",), near=_BESIDE)


# a label's box: as wide as its name
_BOXED = f"(SELECT place_id, row_number() OVER (ORDER BY nation % 2, name, place_id) AS rn, list_distinct(flatten(list_transform(range(CAST(floor((lon - 0.002 * (length(name) % 7)) * 100) AS BIGINT), CAST(floor((lon + 0.002 * (length(name) % 7)) * 100) AS BIGINT) + 1), lambda x: list_transform(range(CAST(floor((lat - 0.004) * 100) AS BIGINT), CAST(floor((lat + 0.004) * 100) AS BIGINT) + 1), lambda y: x * 100000 + y)))) AS cells FROM {PLACES} p)"


@query("w10_label_occupancy", f"WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {_BOXED} b), w(rn, place_id, used, won) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), false UNION ALL SELECT c.rn, c.place_id, CASE WHEN list_has_any(used, cells) THEN used ELSE list_concat(used, cells) END, NOT list_has_any(used, cells) FROM w JOIN c ON c.rn = w.rn + 1) SELECT place_id FROM w WHERE won")
def w10_occupancy(spark, d):
    """Labels in order of importance, each placed unless a cell of its box is taken."""
    half = 0.002 * (F.length("name") % 7)
    side = lambda a, b: F.sequence(F.floor(a * 100), F.floor(b * 100))
    cells = F.flatten(F.transform(side(F.col("lon") - half, F.col("lon") + half), lambda x: F.transform(side(F.col("lat") - 0.004, F.col("lat") + 0.004), lambda y: x * 100000 + y)))
    p = places(spark, d)
    return greedy.unoccupied(p.select(F.col("place_id").alias("node"), F.struct((F.col("nation") % 2).alias("minor"), "name", "place_id").alias("rank"), cells.alias("cells"))).select(F.col("node").alias("place_id"))
