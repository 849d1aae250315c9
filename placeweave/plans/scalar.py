"""Queries: scalar functions on names, hashes and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeweave.functions import names as nm
from placeweave.operators import similarity as sim
from placeweave.operators.polygons import edges

from .base import LAT0, LON0, PLACES, SPAN_LAT, SPAN_LON, STORY, metres, places, query, read, sql_metres, story

PART = lambda spark, d: read(spark, d, "part")


@query("f1_nfkc_names")
def f1(spark, d):
    return PART(spark, d).select("p_partkey", nm.nfkc(F.concat(F.lit(" ｐ"), F.col("p_name"))).alias("name"))


@query("f2_strip_note", "SELECT c_custkey, c_name AS name, c_mktsegment AS note FROM customer")
def f2(spark, d):
    made = F.concat("c_name", F.lit("（"), "c_mktsegment", F.lit("）"))
    name, note = nm.strip_note(made)
    return read(spark, d, "customer").select("c_custkey", name.alias("name"), note.alias("note"))


@query("f3_f6_name_keys", "SELECT p_partkey, regexp_replace(p_brand, '[ .,_#-]', '', 'g') AS plain, lower(regexp_replace(p_name, '[ .]', '', 'g')) AS norm, translate(p_brand, 'O0Il', '0011') AS variant, regexp_replace(lower(p_name), '[aeiou]', '', 'g') AS particle, array_to_string(list_sort(string_split(p_name, '')), '') AS anagram FROM part")
def f3(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return PART(spark, d).select("p_partkey", nm.punctuation_free(b).alias("plain"), nm.normal_name(n).alias("norm"), nm.variant_key(b).alias("variant"), nm.particle_key(n).alias("particle"), nm.anagram_key(n).alias("anagram"))


@query("f8_slugs", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM part")
def f8(spark, d):
    return PART(spark, d).select("p_partkey", nm.slug(F.col("p_name")).alias("slug"))


@query("f9_route_slug", "SELECT user_id, regexp_replace(lower(event_type || ' ' || CAST(user_id AS VARCHAR)), '[^a-z0-9]+', '-', 'g') AS slug FROM events GROUP BY ALL")
def f9(spark, d):
    return read(spark, d, "events").select("user_id", F.regexp_replace(F.lower(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))), "[^a-z0-9]+", "-").alias("slug")).distinct()


@query("f10_f11_generic_suffix", "SELECT p_partkey, CASE WHEN ends_with(p_name, 'widget') AND length(p_name) <= 10 THEN 'widget' WHEN ends_with(p_name, 'gadget') AND length(p_name) <= 10 THEN 'gadget' WHEN ends_with(p_name, 'bolt') AND length(p_name) <= 8 THEN 'bolt' END AS suffix, length(split_part(p_name, ' ', 1)) >= 4 AS distinctive FROM part")
def f10(spark, d):
    n = F.col("p_name")
    return PART(spark, d).select("p_partkey", nm.generic_suffix(n, ["widget", "gadget", "bolt"], 4).alias("suffix"), (F.length(F.substring_index(n, " ", 1)) >= 4).alias("distinctive"))


@query("f12_f13_candidates", f"SELECT place_id, (nation IN (1, 2, 3)) AS is_area, regexp_matches(name, '#0+[0-9]*[05]$') AS road_like, (score < 0 OR seg = 'BUILDING') AND NOT place_id % 10 = 0 AS candidate FROM {PLACES} p")
def f12(spark, d):
    return places(spark, d).select("place_id", F.col("nation").isin(1, 2, 3).alias("is_area"), F.col("name").rlike("#0+[0-9]*[05]$").alias("road_like"), (((F.col("score") < 0) | (F.col("seg") == "BUILDING")) & ~(F.col("place_id") % 10 == 0)).alias("candidate"))


@query("f14_zone_words", "SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN substr(p_name, 1, strpos(p_name, 'widget') + 5) END AS core, CASE WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'BRASS') THEN 'metal' ELSE 'other' END AS kind FROM part")
def f14(spark, d):
    at = F.expr("locate('widget', p_name)")
    return PART(spark, d).select("p_partkey", F.when(at > 0, F.col("p_name").substr(F.lit(1), at + 5)).alias("core"), F.when(F.col("p_type").rlike("STEEL|BRASS"), "metal").otherwise("other").alias("kind"))


@query("f15_usable_names", "SELECT DISTINCT w AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE (length(w) >= 2 OR regexp_matches(w, '^[A-Za-z0-9]$')) AND w NOT IN ('widget', 'red')")
def f15(spark, d):
    w = PART(spark, d).select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return w.filter(nm.usable(F.col("name"), ["widget", "red"]))


@query("f16_single_edits", "WITH n AS (SELECT DISTINCT c_name AS a FROM customer) SELECT x.a, y.a AS b, CASE WHEN length(x.a) = length(y.a) THEN 'sub' WHEN length(x.a) < length(y.a) THEN 'ins' ELSE 'del' END AS kind FROM n x, n y WHERE x.a < y.a AND levenshtein(x.a, y.a) = 1")
def f16(spark, d):
    return sim.single_edits(read(spark, d, "customer"), "c_name")


@query("f17_contrast_pairs", "WITH c(x, y) AS (VALUES ('hot', 'cold'), ('red', 'blue'), ('small', 'large')), w AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b FROM w a, w b, c WHERE split_part(a.n, ' ', 1) = c.x AND split_part(b.n, ' ', 1) = c.y AND split_part(a.n, ' ', 2) = split_part(b.n, ' ', 2)")
def f17(spark, d):
    c = spark.createDataFrame([("hot", "cold"), ("red", "blue"), ("small", "large")], "x string, y string")
    w = PART(spark, d).select("p_name").distinct().select(F.col("p_name").alias("n"), F.substring_index("p_name", " ", 1).alias("h"), F.substring_index("p_name", " ", -1).alias("t"))
    a = w.join(F.broadcast(c), F.col("h") == F.col("x"))
    b = w.select(F.col("n").alias("b"), F.col("h").alias("y"), "t")
    return a.select(F.col("n").alias("a"), "y", "t").join(b, ["y", "t"]).select("a", "b")


@query("f18_char_jaccard", "WITH w AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS a, b.n AS b, round(CAST(len(list_intersect(string_split(a.n, ''), string_split(b.n, ''))) AS DOUBLE) / len(list_distinct(list_concat(string_split(a.n, ''), string_split(b.n, '')))), 6) AS sim FROM w a JOIN w b ON split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) AND a.n < b.n")
def f18(spark, d):
    w = PART(spark, d).select(F.col("p_name").alias("a")).distinct().withColumn("h", F.substring_index("a", " ", 1))
    return w.join(w.withColumnRenamed("a", "b"), "h").filter("a < b").select("a", "b", F.round(nm.char_jaccard(F.col("a"), F.col("b")), 6).alias("sim"))


@query("f19_stable_ids", f"SELECT event_id, 'ev_' || substr(sha1(title || '|' || CAST(chapter AS VARCHAR)), 1, 10) AS sid FROM {STORY} s")
def f19(spark, d):
    return story(spark, d).select("event_id", nm.stable_id("ev_", F.col("title"), F.col("chapter")).alias("sid"))


@query("f20_content_hashes", "SELECT conv_id, turn, sha256(CAST(conv_id AS VARCHAR) || chr(31) || CAST(turn AS VARCHAR) || chr(31) || text) AS h FROM conversations")
def f20(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("\x1f", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text"), 256).alias("h"))


@query("f21_hash_points", f"SELECT place_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {PLACES} p")
def f21(spark, d):
    return places(spark, d).select("place_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("f22_ring_offsets", f"SELECT place_id, round(r * cos(a), 6) AS dx, round(r * sin(a), 6) AS dy FROM (SELECT place_id, 2 * pi() * CAST(CAST('0x' || substr(sha256(name), 1, 6) AS BIGINT) AS DOUBLE) / 16777216.0 AS a, 420 * (0.45 + 0.55 * CAST(CAST('0x' || substr(sha256(name), 7, 6) AS BIGINT) AS DOUBLE) / 16777216.0) AS r FROM {PLACES} p)")
def f22(spark, d):
    h = F.sha2("name", 256)
    u = lambda k: F.conv(F.substring(h, k, 6), 16, 10).cast("long") / F.lit(16777216.0)
    x = places(spark, d).select("place_id", (2 * F.pi() * u(1)).alias("a"), (420 * (0.45 + 0.55 * u(7))).alias("r"))
    return x.select("place_id", F.round(F.col("r") * F.cos("a"), 6).alias("dx"), F.round(F.col("r") * F.sin("a"), 6).alias("dy"))


@query("f23_hash_modulo", "SELECT n_nationkey, CAST(list_reduce(list_prepend(0, [CAST('0x' || x AS BIGINT) FOR x IN string_split(sha256(n_name), '')]), lambda a, x: (a * 16 + x) % 700) AS BIGINT) AS cell FROM nation")
def f23(spark, d):
    return read(spark, d, "nation").select("n_nationkey", nm.hash_mod(F.col("n_name"), 700).alias("cell"))


@query("f24_story_position", f"SELECT place_id, round(least(1, greatest(0, (lon - {LON0}) / {SPAN_LON})), 3) AS x, round(least(1, greatest(0, 1 - (lat - {LAT0}) / {SPAN_LAT})), 3) AS y FROM {PLACES} p")
def f24(spark, d):
    return places(spark, d).select("place_id", F.round(nm.clamp((F.col("lon") - LON0) / SPAN_LON, 0.0, 1.0), 3).alias("x"), F.round(nm.clamp(1 - (F.col("lat") - LAT0) / SPAN_LAT, 0.0, 1.0), 3).alias("y"))


@query("f25_distances", f"SELECT a.place_id AS a, b.place_id AS b, round({sql_metres('a', 'b')}, 3) AS m FROM {PLACES} a JOIN {PLACES} b ON b.place_id = a.place_id + 1")
def f25(spark, d):
    a = places(spark, d).select(F.col("place_id").alias("a"), "lon", "lat")
    b = a.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, "a").select("a", "b", F.round(metres(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("m"))


@query("f26_pixels", f"SELECT place_id, CAST(floor(1024 * (lon - {LON0}) / {SPAN_LON}) AS BIGINT) AS px, CAST(floor(768 * (1 - (lat - {LAT0}) / {SPAN_LAT})) AS BIGINT) AS py FROM {PLACES} p")
def f26(spark, d):
    return places(spark, d).select("place_id", F.floor(1024 * (F.col("lon") - LON0) / SPAN_LON).alias("px"), F.floor(768 * (1 - (F.col("lat") - LAT0) / SPAN_LAT)).alias("py"))


@query("f27_shoelace_area", f"WITH v AS (SELECT nation, place_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, first_value(lon) OVER w AS lon0, first_value(lat) OVER w AS lat0 FROM {PLACES} p WINDOW w AS (PARTITION BY nation ORDER BY place_id)) SELECT nation, round(abs(sum(lon * coalesce(lat2, lat0) - coalesce(lon2, lon0) * lat)) / 2, 6) AS area FROM v GROUP BY nation")
def f27(spark, d):
    e = edges(places(spark, d).select(F.col("nation").alias("ring"), F.col("place_id").alias("pos"), "lon", "lat"))
    return e.groupBy(F.col("ring").alias("nation")).agg(F.round(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2, 6).alias("area"))


@query("f28_bounds", f"SELECT place_id, lon BETWEEN 114.0 AND 114.3 AND lat BETWEEN 22.25 AND 22.45 AS in_region, lon BETWEEN 113.9 AND 114.4 AS in_bounds FROM {PLACES} p")
def f28(spark, d):
    return places(spark, d).select("place_id", (F.col("lon").between(114.0, 114.3) & F.col("lat").between(22.25, 22.45)).alias("in_region"), F.col("lon").between(113.9, 114.4).alias("in_bounds"))


@query("f29_bands", f"SELECT CASE WHEN conf >= 0.9 THEN 'high' WHEN conf >= 0.7 THEN 'good' WHEN conf >= 0.5 THEN 'fair' ELSE 'low' END AS band, CASE WHEN conf >= 0.7 THEN 'approved' ELSE 'needs_review' END AS status, count(*) AS n FROM {STORY} s GROUP BY 1, 2")
def f29(spark, d):
    return story(spark, d).groupBy(nm.band(F.col("conf")).alias("band"), F.when(F.col("conf") >= 0.7, "approved").otherwise("needs_review").alias("status")).agg(F.count("*").alias("n"))


@query("f30_f31_sort_keys", f"SELECT event_id, coalesce(CASE WHEN k % 7 = 0 THEN 'k' || CAST(k AS VARCHAR) END, 'ch' || lpad(CAST(chapter AS VARCHAR), 3, '0')) AS skey, least(20, greatest(5, chapter)) AS clamped FROM {STORY} s")
def f30(spark, d):
    given = F.when(F.col("k") % 7 == 0, F.concat(F.lit("k"), F.col("k").cast("string")))
    return story(spark, d).select("event_id", nm.sort_key(given, F.col("chapter")).alias("skey"), nm.clamp(F.col("chapter"), 5, 20).alias("clamped"))


@query("f32_short_labels", "SELECT p_partkey, CASE WHEN length(n) <= 18 THEN n WHEN regexp_extract(substr(n, 1, 18), '^(.*) [^ ]*$', 1) <> '' THEN regexp_extract(substr(n, 1, 18), '^(.*) [^ ]*$', 1) ELSE substr(n, 1, 18) END AS label FROM (SELECT p_partkey, p_name || ' ' || p_type AS n FROM part)")
def f32(spark, d):
    n = F.concat_ws(" ", "p_name", "p_type")
    return PART(spark, d).select("p_partkey", n.alias("n")).select("p_partkey", nm.short_label(F.col("n")).alias("label"))


@query("f33_digit_parse", "SELECT c_custkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number FROM customer")
def f33(spark, d):
    full = F.translate("c_name", nm.HALF_DIGITS, nm.FULL_DIGITS)
    return read(spark, d, "customer").select("c_custkey", F.regexp_extract(F.translate(full, nm.FULL_DIGITS, nm.HALF_DIGITS), "[0-9]+", 0).cast("long").alias("number"))


@query("f34_cue_windows", "SELECT doc_id, regexp_matches(substr(text, CAST(greatest(1, strpos(text, 'License') - 18) AS BIGINT), 43), 'under|with') AS cued FROM documents WHERE contains(text, 'License')")
def f34(spark, d):
    at = F.expr("locate('License', text)")
    return read(spark, d, "documents").filter(F.contains("text", F.lit("License"))).select("doc_id", F.col("text").substr(F.greatest(F.lit(1), at - 18), F.lit(43)).rlike("under|with").alias("cued"))


CUES = ["red", "blue", "cold", "hot", "widget"]


@query("f35_cue_scores", "SELECT p_partkey, " + " + ".join(f"CAST(contains(p_name, '{c}') AS BIGINT)" for c in CUES) + " AS score FROM part")
def f35(spark, d):
    score = F.aggregate(F.array(*[F.contains("p_name", F.lit(c)).cast("long") for c in CUES]), F.lit(0).cast("long"), lambda a, x: a + x)
    return PART(spark, d).select("p_partkey", score.alias("score"))


@query("f36_html_escape", "SELECT doc_id, sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM documents")
def f36(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(nm.escape_html(F.col("text")), 256).alias("h"))


@query("l7_cue_order", "SELECT p_partkey, score FROM (SELECT p_partkey, " + " + ".join(f"CAST(contains(p_name, '{c}') AS BIGINT)" for c in CUES) + " AS score FROM part) ORDER BY score DESC, p_partkey LIMIT 25")
def l7(spark, d):
    return f35(spark, d).orderBy(F.desc("score"), "p_partkey").limit(25)
