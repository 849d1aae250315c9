"""Queries: rules in full where others show their core: excerpts, claims, roles, script classes, index sets, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import match as mt
from placeweave.operators import text as tx
from placeweave.operators.graph import kept

from .base import query, read
from .regions import _RING, rings
from .release import INFERRED, inferred
from .text import WC
from .tiers import _INDEX, HAPPENED, happened
from .zones import named

_PUNCT = r"[^\p{L}\p{N}_\p{Z}\s]"
_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
_MIXED = "CASE WHEN doc_id % 9 = 0 THEN repeat('漢字', 40) || text WHEN doc_id % 11 = 0 THEN repeat('—…', 200) || text WHEN doc_id % 13 = 0 THEN repeat('жю', 900) || text ELSE text END"
_SHARE = "CAST(length(t) - length(regexp_replace(t, '{}', '', 'g')) AS DOUBLE) / greatest(1, n)"


@query("t9_script_warnings", f"WITH x AS (SELECT doc_id, t, {WC.replace('text', 't')} AS n FROM (SELECT doc_id, {_MIXED} AS t FROM documents)), r AS (SELECT doc_id, {_SHARE.format(_CJK)} AS cjk, {_SHARE.format('[A-Za-z]')} AS latin, {_SHARE.format(_PUNCT)} AS punct FROM x) SELECT doc_id, round(cjk, 3) AS cjk, round(latin, 3) AS latin, round(punct, 3) AS punct, cjk + latin < 0.5 AS low_text, punct > 0.35 AS high_punctuation FROM r WHERE cjk + latin < 0.5 OR punct > 0.35")
def t9_warnings(spark, d):
    """Documents with too few letters of the expected scripts, or too many marks, for the characters they have."""
    k = lambda m: F.col("doc_id") % m == 0
    t = F.when(k(9), F.concat(F.lit("漢字" * 40), "text")).when(k(11), F.concat(F.lit("—…" * 200), "text")).when(k(13), F.concat(F.lit("жю" * 900), "text")).otherwise(F.col("text"))
    x = read(spark, d, "documents").select("doc_id", t.alias("t"))
    share = lambda p: (F.length("t") - F.length(F.regexp_replace("t", p, ""))).cast("double") / F.greatest(F.lit(1), tx.word_count(F.col("t")))
    r = x.select("doc_id", share(_CJK).alias("cjk"), share("[A-Za-z]").alias("latin"), share(r"[^\p{L}\p{N}_\p{Z}\s]").alias("punct"))
    r = r.withColumn("low_text", F.col("cjk") + F.col("latin") < 0.5).withColumn("high_punctuation", F.col("punct") > 0.35).filter("low_text or high_punctuation")
    return r.select("doc_id", F.round("cjk", 3).alias("cjk"), F.round("latin", 3).alias("latin"), F.round("punct", 3).alias("punct"), "low_text", "high_punctuation")


@query("t8_cut_bytes", "SELECT doc_id, try(decode(unhex(left(hex(encode(text)), 2 * (doc_id % 300 + 1))))) IS NOT NULL AS ok FROM documents WHERE text IS NOT NULL")
def t8_bytes(spark, d):
    """Whether a text's bytes, cut at some place, still are valid Unicode."""
    cut = F.expr("substring(encode(text, 'UTF-8'), 1, cast(doc_id % 300 + 1 as int))")
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.is_valid_utf8(cut.cast("string")).alias("ok"))


@query("t12_index_sets", """WITH m AS (SELECT max(c_custkey) AS top FROM customer), a AS (SELECT o_custkey AS id, count(*) FILTER (o_orderkey % 40 = 0) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), e AS (SELECT unnest(range(1, (SELECT top FROM m) * 9 // 10)) AS id)
 SELECT 'missing' AS what, e.id FROM e ANTI JOIN a USING (id) UNION ALL SELECT 'unexpected', a.id FROM a ANTI JOIN e USING (id) UNION ALL SELECT 'duplicate', id FROM a WHERE n > 1 UNION ALL SELECT 'forbidden', id FROM a WHERE id % 250 = 0""")
def t12_sets(spark, d):
    """Indices that are missing, not expected, there more than once, or forbidden."""
    a = kept(read(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count_if(F.col("o_orderkey") % 40 == 0).alias("n")), "indices")
    top = read(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    e = spark.range(1, top * 9 // 10)
    out = lambda what, df: df.select(F.lit(what).alias("what"), "id")
    return out("missing", e.join(a, "id", "left_anti")).union(out("unexpected", a.join(e, "id", "left_anti"))).union(out("duplicate", a.filter("n > 1"))).union(out("forbidden", a.filter("id % 250 = 0")))


_WORD = "regexp_extract(text, '[A-Za-z]{5,}')"


@query("t20_capped_excerpts", f"""WITH w AS (SELECT DISTINCT {_WORD} AS name FROM benchmark WHERE {_WORD} <> ''), h AS (SELECT name, doc_id, text, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS chapter FROM w JOIN documents ON contains(text, name)),
 p AS (SELECT name, doc_id, chapter, text, instr(text, name) AS a FROM h WHERE chapter <= 2), q AS (SELECT *, instr(substr(text, a + length(name)), name) AS b FROM p),
 o AS (SELECT name, doc_id, chapter, text, a AS pos FROM q UNION ALL SELECT name, doc_id, chapter, text, a + length(name) + b - 1 FROM q WHERE b > 0), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY chapter, pos) AS nr FROM o)
 SELECT name, nr, doc_id, trim(replace(substr(text, greatest(1, pos - 80), pos + length(name) + 80 - greatest(1, pos - 80)), chr(10), ' ')) AS excerpt FROM r WHERE nr <= 3""")
def t20_capped(spark, d):
    """Texts round a name's mentions: two of its chapters, two mentions in each, three in all."""
    w = read(spark, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("name")).filter("name <> ''").distinct()
    docs = read(spark, d, "documents").select("doc_id", "text")
    hits = mt.mentions(docs, w, "text", "name").select("name", "doc_id")
    first = hits.withColumn("chapter", F.row_number().over(Window.partitionBy("name").orderBy("doc_id"))).filter("chapter <= 2")
    n, a = F.length("name"), F.instr("text", F.col("name"))
    x = docs.join(first, "doc_id").withColumn("a", a).withColumn("b", F.instr(F.col("text").substr(F.col("a") + n, F.length("text")), F.col("name")))
    o = x.withColumn("pos", F.explode(F.array_compact(F.array(F.col("a"), F.when(F.col("b") > 0, F.col("a") + n + F.col("b") - 1)))))
    r = o.withColumn("nr", F.row_number().over(Window.partitionBy("name").orderBy("chapter", "pos"))).filter("nr <= 3")
    start = F.greatest(F.lit(1), F.col("pos") - 80)
    return r.select("name", F.col("nr").cast("long").alias("nr"), "doc_id", F.trim(F.replace(F.col("text").substr(start, F.col("pos") + n + 80 - start), F.lit("\n"), F.lit(" "))).alias("excerpt"))


LIMIT, MARKS = 120, ".;!?"


def short_claim(t, limit: int = LIMIT, marks: str = MARKS):
    """A text of at most ``limit`` characters: cut behind the first mark, in the order of ``marks``, that comes after twenty
    characters or more; if it is still too long, at the limit, or behind the last mark or comma that stands beyond the thirtieth
    character. Unbroken runs of a hundred Han characters get a comma in the middle."""
    seed = t
    for m in reversed(marks):
        head = F.substring_index(t, m, 1)
        seed = F.when(F.contains(t, F.lit(m)) & (F.length(head) >= 20), F.concat(head, F.lit(m))).otherwise(seed)
    seed = F.when(F.length(t) > limit, seed).otherwise(t)
    cut = F.substring(seed, 1, limit - 1)
    last = F.greatest(*[F.when(F.contains(cut, F.lit(m)), F.length(cut) - F.instr(F.reverse(cut), F.lit(m)) + 1).otherwise(0) for m in marks + ","])
    cut = F.when(last > 31, cut.substr(F.lit(1), last)).otherwise(cut)
    out = F.when(F.length(seed) > limit, cut).otherwise(seed)
    runs = F.regexp_extract_all(out, F.lit(r"([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+|[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+)"), F.lit(1))
    half = lambda r: F.floor(F.length(r) / 2).cast("int")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{100,}"), F.concat(r.substr(F.lit(1), half(r)), F.lit("，"), r.substr(half(r) + 1, F.length(r)))).otherwise(r)), "")


_CLAIM = "(SELECT source, lang, arg_min(CASE WHEN doc_id % 17 = 0 THEN repeat('漢', 110) ELSE replace(text, chr(10), ' ') END, {'l': CASE WHEN doc_id % 17 = 0 THEN 110 ELSE length(text) END, 'i': doc_id}) AS t FROM documents WHERE length(text) >= 150 GROUP BY 1, 2)"
_SEED = "CASE WHEN length(t) <= 120 THEN t " + " ".join(f"WHEN contains(t, '{m}') AND length(split_part(t, '{m}', 1)) >= 20 THEN split_part(t, '{m}', 1) || '{m}'" for m in MARKS) + " ELSE t END"
_LAST = "greatest(" + ", ".join(f"CASE WHEN contains(c, '{m}') THEN length(c) - instr(reverse(c), '{m}') + 1 ELSE 0 END" for m in MARKS + ",") + ")"


@query("t24_claim_cut", f"""WITH s AS (SELECT source, lang, {_SEED} AS s FROM {_CLAIM} q), c AS (SELECT *, substr(s, 1, 119) AS c FROM s), o AS (SELECT source, lang, CASE WHEN length(s) <= 120 THEN s WHEN {_LAST} > 31 THEN substr(c, 1, {_LAST}) ELSE c END AS o FROM c)
 SELECT source, lang, array_to_string(list_transform(regexp_extract_all(o, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]+|[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: CASE WHEN regexp_matches(r, '^[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]{{100,}}') THEN substr(r, 1, length(r) // 2) || '，' || substr(r, length(r) // 2 + 1) ELSE r END), '') AS claim FROM o""")
def t24_cut(spark, d):
    """The shortest claim of each group, cut at a sentence."""
    han = F.col("doc_id") % 17 == 0
    t = F.when(han, "漢" * 110).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    x = read(spark, d, "documents").filter(F.length("text") >= 150).select("source", "lang", "doc_id", t.alias("t"))
    return x.groupBy("source", "lang").agg(F.min_by("t", F.struct(F.length("t"), "doc_id")).alias("t")).select("source", "lang", short_claim(F.col("t")).alias("claim"))


@query("j2_mention_roles", f"SELECT event_id, place AS name, CASE WHEN bool_or(title) THEN 'subject' ELSE 'mentioned' END AS role FROM (SELECT event_id, place, true AS title FROM {HAPPENED} h JOIN {_INDEX} i ON contains(name, place) UNION ALL SELECT event_id, place, false FROM {HAPPENED} h JOIN {_INDEX} i ON contains(claim, place)) GROUP BY 1, 2")
def j2_mentions(spark, d):
    """Who an event is about: names in its title are subjects, others in its text are mentioned."""
    e = kept(happened(spark, d).select("event_id", "name", "claim"), "events")
    index = kept(named(spark, d).select(F.col("name").alias("place")).distinct(), "index")
    title = mt.mentions(e.select("event_id", "name"), index, "name", "place").select("event_id", "place", F.lit(True).alias("title"))
    told = mt.mentions(e.select("event_id", "claim"), index, "claim", "place").select("event_id", "place", F.lit(False).alias("title"))
    return title.union(told).groupBy("event_id", F.col("place").alias("name")).agg(F.when(F.bool_or("title"), "subject").otherwise("mentioned").alias("role"))


@query("j8_other_places", f"SELECT event_id, arg_max(place, {{'l': length(place), 'r': -place_id}}) AS place FROM {HAPPENED} h JOIN {_INDEX} i ON contains(claim, place) AND place <> name WHERE name NOT IN (SELECT place FROM {_INDEX} q) GROUP BY 1")
def j8_others(spark, d):
    """The longest place in what is told of someone; who bears a place's name is left out."""
    index = kept(named(spark, d).groupBy(F.col("name").alias("place")).agg(F.min("place_id").alias("place_id")), "index")
    e = happened(spark, d).join(index.select(F.col("place").alias("name")), "name", "left_anti")
    hits = mt.mentions(e.select("event_id", "name", "claim"), index, "claim", "place").filter("place <> name")
    return hits.groupBy("event_id").agg(F.max_by("place", F.struct(F.length("place").alias("l"), (-F.col("place_id")).alias("r"))).alias("place"))


_VARIANT = f"(SELECT id, subject % 97 AS key, subject, conf, status FROM {INFERRED} i)"


@query("e10_supersede", f"""WITH v AS (SELECT * FROM {_VARIANT} x), s AS (SELECT key, max(conf) AS top, arg_max(id, {{'c': conf, 'i': -id}}) AS strongest FROM v WHERE status = 'approved' AND conf >= 0.7 GROUP BY 1),
 n AS (SELECT v.subject, s.strongest, round(max(top) * 0.95, 4) AS conf, max(v.conf) AS own FROM v JOIN s USING (key) GROUP BY v.subject, s.strongest, s.top HAVING max(v.conf) < s.top)
 SELECT 'propagated' AS origin, strongest AS id, subject, conf FROM n UNION ALL SELECT 'own', id, subject, round(conf, 4) FROM v WHERE NOT (conf < 0.7 AND subject IN (SELECT subject FROM n))""")
def e10_supersede(spark, d):
    """The strongest sure inference of a group of variants carries over to its weaker subjects, at a little less; what these had
    below 0.7 is superseded."""
    v = kept(inferred(spark, d).select("id", (F.col("subject") % 97).alias("key"), "subject", "conf", "status"), "variants")
    s = v.filter("status = 'approved' and conf >= 0.7").groupBy("key").agg(F.max("conf").alias("top"), F.max_by("id", F.struct("conf", (-F.col("id")).alias("i"))).alias("strongest"))
    own = v.groupBy("key", "subject").agg(F.max("conf").alias("own"))
    n = mt.salted(own, s, ["key"], F.col("subject")).filter("own < top").select(F.lit("propagated").alias("origin"), F.col("strongest").alias("id"), "subject", F.round(F.col("top") * 0.95, 4).alias("conf"))
    n = kept(n, "propagated")
    weak = v.filter("conf < 0.7").join(n.select("subject"), "subject", "left_anti").unionByName(v.filter("conf >= 0.7"))
    return n.union(weak.select(F.lit("own"), "id", "subject", F.round("conf", 4)))


_FEATURE = f"(SELECT ring AS id, CASE ring % 10 WHEN 0 THEN '翠林' || polygon || ' Estate' WHEN 1 THEN 'Tower ' || polygon ELSE '翠林 Hall' END AS name, CASE WHEN ring % 10 = 1 THEN '塔' || polygon END AS name_zh, CASE WHEN ring % 10 = 0 THEN 'residential' END AS landuse, CASE WHEN polygon % 2 = 0 THEN 'school' END AS amenity, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n FROM {_RING} r GROUP BY polygon, ring)"


@query("s6_feature_keys", f"WITH f AS (SELECT * FROM {_FEATURE} x), k AS (SELECT unnest([name, name_zh, regexp_extract(name, '^[^\\x{{00}}-\\x{{7f}}]+')]) AS key, * FROM f) SELECT key, id, coalesce(amenity, landuse, 'other') AS kind, round(lon, 6) AS lon, round(lat, 6) AS lat FROM k WHERE length(key) >= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, id) = 1")
def s6_features(spark, d):
    """A gazetteer of features: the mean of the vertices, the kind by the first tag that is set, found by name, second name and
    the part before the first ASCII character; of features with one key the one of most vertices stays."""
    part, p = F.col("ring") % 10, F.col("polygon").cast("string")
    f = rings(spark, d).groupBy("polygon", "ring").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"))
    name = F.when(part == 0, F.concat(F.lit("翠林"), p, F.lit(" Estate"))).when(part == 1, F.concat(F.lit("Tower "), p)).otherwise("翠林 Hall")
    tags = F.create_map(F.lit("amenity"), F.when(F.col("polygon") % 2 == 0, "school"), F.lit("landuse"), F.when(part == 0, "residential"))
    f = f.select(F.col("ring").alias("id"), name.alias("name"), F.when(part == 1, F.concat(F.lit("塔"), p)).alias("name_zh"), tags.alias("tags"), "lon", "lat", "n")
    kind = F.coalesce(*[F.element_at("tags", F.lit(t)) for t in ("amenity", "landuse")], F.lit("other"))
    keys = F.array("name", "name_zh", F.regexp_extract("name", r"^[^\x00-\x7f]+", 0))
    k = f.select(F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), "id", kind.alias("kind"), "lon", "lat", "n").filter("length(key) >= 2")
    return k.groupBy("key").agg(F.max(F.struct("n", (-F.col("id")).alias("i"), "id", "kind", "lon", "lat")).alias("b")).select("key", "b.id", "b.kind", F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))
