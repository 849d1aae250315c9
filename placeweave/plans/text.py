"""Queries: text cleaning, validation, profiles and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import match as mt
from placeweave.operators import text as tx
from placeweave.operators.numbering import numbered

from .base import query, read

WC = f"CAST(length(regexp_replace(text, '{tx.SPACE}+', '', 'g')) AS BIGINT)"
IP, MAIL, HEX = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"[A-Za-z0-9._]+@mail[0-9]+\.example\.com", r'token = "[0-9a-f]{40}"'
STRIP = r"regexp_replace(regexp_replace({0}, '^[ \t\r\n]+', ''), '[ \t\r\n]+$', '')"
CLEANED = f"""(SELECT doc_id, lang, source, text, {STRIP.format(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{IP}', '', 'g'), '{MAIL}', '', 'g'), '{HEX}', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS clean_text,
 length(text) - length(regexp_replace(text, '{IP}', '', 'g')) AS cut_address,
 length(regexp_replace(text, '{IP}', '', 'g')) - length(regexp_replace(regexp_replace(text, '{IP}', '', 'g'), '{MAIL}', '', 'g')) AS cut_mail FROM documents)"""
DOCS = lambda spark, d: read(spark, d, "documents")


@query("t1_clean_pipeline", f"SELECT doc_id, sha256(clean_text) AS clean_hash, CAST(cut_address AS BIGINT) AS cut_address, CAST(cut_mail AS BIGINT) AS cut_mail FROM {CLEANED}")
def t1(spark, d):
    return tx.clean(DOCS(spark, d)).select("doc_id", F.sha2("clean_text", 256).alias("clean_hash"), "cut_address", "cut_mail")


@query("a1_cleaning_totals", f"SELECT lang, count(*) AS n_docs, CAST(sum(cut_address) AS BIGINT) AS cut_address, CAST(sum(cut_mail) AS BIGINT) AS cut_mail, count(*) FILTER (cut_address > 0) AS with_address FROM {CLEANED} GROUP BY lang")
def a1(spark, d):
    c = tx.clean(DOCS(spark, d))
    return c.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("cut_address").alias("cut_address"), F.sum("cut_mail").alias("cut_mail"), F.count_if(F.col("cut_address") > 0).alias("with_address"))


@query("t2_word_count", f"SELECT doc_id, {WC} AS wc FROM documents")
def t2(spark, d):
    return DOCS(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("wc"))


@query("s2_required_fields", "SELECT event_id, len(list_filter([CASE WHEN ts IS NULL THEN 'ts' END, CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN value < 1 THEN 'value' END], lambda x: x IS NOT NULL)) AS n_missing FROM events")
def s2(spark, d):
    e = read(spark, d, "events")
    miss = F.array_compact(F.array(F.when(F.col("ts").isNull(), "ts"), F.when(F.col("user_id").isNull(), "user_id"), F.when(F.col("value") < 1, "value")))
    return e.select("event_id", F.size(miss).cast("long").alias("n_missing"))


@query("t3_row_routing", """WITH b AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN NULL ELSE conv_id % 50 END AS k FROM conversations),
 v AS (SELECT *, (k IS NOT NULL AND k <> 0 AND length(trim(text)) > 0) AS valid FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY k, valid ORDER BY conv_id, turn) AS rn FROM v)
 SELECT CASE WHEN k IS NULL THEN 'error' WHEN k = 0 THEN 'skipped' WHEN NOT valid THEN 'blank' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS disposition, count(*) AS n FROM r GROUP BY 1""")
def t3(spark, d):
    c = read(spark, d, "conversations").withColumn("k", F.col("conv_id") % 50).withColumn("pos", F.struct("conv_id", "turn"))
    return tx.route(c, "k", "pos").groupBy("disposition").agg(F.count("*").alias("n"))


NOISE = [("address", IP), ("mail", MAIL), ("licence", "Licensed under|All rights reserved")]


@query("t4_residual_noise", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, CAST(strpos(text, regexp_extract(text, '({p})', 1)) AS BIGINT) AS pos FROM documents WHERE regexp_matches(text, '{p}')" for n, p in NOISE))
def t4(spark, d):
    return tx.detect(DOCS(spark, d), NOISE, "doc_id").select("doc_id", "rule", "pos")


@query("t5_token_detector", "SELECT doc_id, tok, CAST(strpos(text, tok) AS BIGINT) AS pos, substr(text, CAST(greatest(1, strpos(text, tok) - 25) AS BIGINT), 50) AS context FROM documents, (VALUES ('MIT License'), ('token ='), ('example.com'), ('!!')) t(tok) WHERE contains(text, tok)")
def t5(spark, d):
    toks = F.explode(F.array(*[F.lit(x) for x in ("MIT License", "token =", "example.com", "!!")]))
    x = DOCS(spark, d).select("doc_id", "text", toks.alias("tok")).filter(F.contains("text", "tok"))
    pos = F.expr("locate(tok, text)")
    return x.select("doc_id", "tok", pos.cast("long").alias("pos"), F.col("text").substr(F.greatest(F.lit(1), pos - 25), F.lit(50)).alias("context"))


@query("t6_minimum_length", f"SELECT doc_id, {WC} AS wc FROM documents WHERE {WC} <= 100")
def t6(spark, d):
    return t2(spark, d).filter("wc <= 100")


@query("t7_control_characters", "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS BIGINT) AS n_control, CAST(length(text) - length(replace(text, '|', '')) AS BIGINT) AS n_bars FROM documents")
def t7(spark, d):
    size = F.length("text")
    return DOCS(spark, d).select("doc_id", (size - F.length(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))).cast("long").alias("n_control"), (size - F.length(F.translate("text", "|", ""))).cast("long").alias("n_bars"))


@query("t7_bar_positions", "SELECT doc_id, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) = '|')[1:10] AS first_positions FROM documents WHERE contains(text, '|')")
def t7b(spark, d):
    at = F.filter(F.transform(F.split("text", ""), lambda c, i: F.when(c == "|", i + 1)), lambda x: x.isNotNull())
    return DOCS(spark, d).filter(F.contains("text", F.lit("|"))).select("doc_id", F.slice(at, 1, 10).cast("array<bigint>").alias("first_positions"))


@query("t8_invalid_unicode")
def t8(spark, d):
    return read(spark, d, "pages").select("page_id", F.is_valid_utf8("html").alias("ok"))


@query("t9_script_ratios", f"SELECT doc_id, round(CAST(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS DOUBLE) / greatest(1, {WC}), 3) AS latin, round(CAST(length(text) - length(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')) AS DOUBLE) / greatest(1, {WC}), 3) AS punct FROM documents")
def t9(spark, d):
    wc = F.greatest(F.lit(1), tx.word_count(F.col("text")))
    share = lambda p: F.round((F.length("text") - F.length(F.regexp_replace("text", p, ""))).cast("double") / wc, 3)
    return DOCS(spark, d).select("doc_id", share("[A-Za-z]").alias("latin"), share(r"[!-/:-@\[-`{-~]").alias("punct"))


@query("t10_length_outliers", f"WITH w AS (SELECT doc_id, {WC} AS wc FROM documents), m AS (SELECT median(wc) AS med FROM w) SELECT doc_id, wc FROM w, m WHERE wc < 0.55 * med")
def t10(spark, d):
    w = t2(spark, d)
    return w.join(F.broadcast(w.agg(F.percentile("wc", 0.5).alias("med"))), F.col("wc") < 0.55 * F.col("med")).select("doc_id", "wc")


@query("t11_exact_duplicates", "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) WHERE doc_id <> first_id")
def t11(spark, d):
    h = DOCS(spark, d).select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("h"))  # missing texts are equal
    first = h.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")  # only texts that recur travel
    return mt.salted(h, first, ["h"], F.col("doc_id")).filter("doc_id <> first_id").select("doc_id", "first_id")


@query("t12_completeness", "WITH e AS (SELECT unnest(range(0, 1 + (SELECT max(conv_id) FROM conversations))) AS id), a AS (SELECT conv_id AS id, count(*) AS n FROM conversations WHERE turn = 0 GROUP BY 1) SELECT 'missing' AS what, e.id FROM e ANTI JOIN a USING (id) UNION ALL SELECT 'duplicate', id FROM a WHERE n > 1")
def t12(spark, d):
    c = read(spark, d, "conversations")
    top = c.agg(F.max("conv_id").alias("m"))
    expect = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("id"))
    seen = c.filter("turn = 0").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"))
    return expect.join(seen, "id", "left_anti").select(F.lit("missing").alias("what"), "id").union(seen.filter("n > 1").select(F.lit("duplicate"), "id"))


@query("t13_verdict", f"WITH w AS (SELECT doc_id, {WC} AS wc, text FROM documents), f AS (SELECT doc_id, 2 AS sev FROM w WHERE wc <= 100 UNION ALL SELECT doc_id, 1 FROM w WHERE regexp_matches(text, '{IP}') UNION ALL SELECT doc_id, 1 FROM w WHERE contains(text, '!!')) SELECT doc_id, max(sev) AS verdict, count(*) AS n_findings FROM f GROUP BY doc_id")
def t13(spark, d):
    w = DOCS(spark, d).select("doc_id", "text", tx.word_count(F.col("text")).alias("wc"))
    found = F.array_compact(F.array(F.when(F.col("wc") <= 100, 2), F.when(F.col("text").rlike(IP), 1), F.when(F.contains("text", F.lit("!!")), 1)))
    return w.select("doc_id", F.explode(found).alias("sev")).groupBy("doc_id").agg(F.max("sev").alias("verdict"), F.count("*").alias("n_findings"))


@query("t14_short_profile", f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS paragraphs, CAST(length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) AS BIGINT) AS sentences, substr(text, 1, 40) AS head, right(text, 40) AS tail FROM documents WHERE {WC} <= 300")
def t14(spark, d):
    x = DOCS(spark, d).filter(tx.word_count(F.col("text")) <= 300)
    return x.select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda p: F.length(F.trim(p)) > 0)).cast("long").alias("paragraphs"), F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("sentences"), F.substring("text", 1, 40).alias("head"), F.expr("right(text, 40)").alias("tail"))


@query("t15_governance_scan", "WITH leaves AS (SELECT 'documents' AS ds, CAST(doc_id AS VARCHAR) AS id, text AS leaf FROM documents UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations), rules(rule, pat) AS (VALUES ('long_run', '[^ \\n]{40,}'), ('secret', 'token = \"[0-9a-f]{40}\"'), ('private_ip', '192\\.168\\.')) SELECT ds, id, rule FROM leaves, rules WHERE regexp_matches(leaf, pat)")
def t15(spark, d):
    leaves = DOCS(spark, d).select(F.lit("documents").alias("ds"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("leaf"))
    leaves = leaves.union(read(spark, d, "conversations").select(F.lit("conversations"), F.concat_ws(":", "conv_id", "turn"), "text"))
    rules = [("long_run", r"[^ \n]{40,}"), ("secret", HEX), ("private_ip", r"192\.168\.")]
    hits = F.array_compact(F.array(*[F.when(F.col("leaf").rlike(p), n) for n, p in rules]))
    return leaves.select("ds", "id", F.explode(hits).alias("rule"))


@query("t16_leak_scan", "WITH r(rule, pat) AS (VALUES ('mail', '[A-Za-z0-9._]+@[A-Za-z0-9.]+'), ('aws', 'AKIA[0-9A-Z]{16}'), ('hex', '[0-9a-f]{40}'), ('ip', '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}')) SELECT source, rule, count(*) AS n_docs FROM documents, r WHERE regexp_matches(text, pat) GROUP BY source, rule")
def t16(spark, d):
    rules = [("mail", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("aws", "AKIA[0-9A-Z]{16}"), ("hex", "[0-9a-f]{40}"), ("ip", IP)]
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in rules]))
    return DOCS(spark, d).select("source", F.explode(hits).alias("rule")).groupBy("source", "rule").agg(F.count("*").alias("n_docs"))


@query("t17_range_spec", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT unnest(range(5, 41)) UNION ALL SELECT 77 UNION ALL SELECT unnest(range(90, 96)))")
def t17(spark, d):
    spec = DOCS(spark, d).agg(F.lit("5-40,77,90-95").alias("spec"), F.max("doc_id").alias("top"))
    part = spec.select("top", F.explode(F.split("spec", ",")).alias("p")).select("top", F.split("p", "-").alias("p"))
    ids = part.select(F.explode(F.sequence(F.col("p")[0].cast("long"), F.least("top", F.coalesce(F.get("p", F.lit(1)), F.col("p")[0]).cast("long")))).alias("doc_id"))
    return DOCS(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("t18_segments")
def t18(spark, d):
    s = tx.segments(DOCS(spark, d), "doc_id")
    return s.select("doc_id", F.col("segment_index").cast("long").alias("segment_index"), F.length("segment").cast("long").alias("n_chars"), F.sha2("segment", 256).alias("hash"))


@query("t19_segment_plan")
def t19(spark, d):
    per = t18(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return per.agg(F.sum("n").alias("segments"), F.sum("chars").alias("total_chars"), F.count_if(F.col("n") > 1).alias("split_docs"))


# the fold over a text's paragraphs, a step for each
_FOLD = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM documents), q AS MATERIALIZED (SELECT doc_id, t, list_transform(string_split(t, chr(10) || chr(10)), lambda x: length(x)) AS ns FROM d WHERE length(t) > 2000),
 w(doc_id, i, pos, s, e, size, done) AS (SELECT doc_id, 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, n BIGINT)[]) FROM q UNION ALL
  SELECT doc_id, i + 1, pos + n + 2, CASE WHEN flush OR s IS NULL THEN pos + cuts * 2000 ELSE s END, pos + n, CASE WHEN flush THEN 0 ELSE size END + n - cuts * 2000,
   list_concat(CASE WHEN flush THEN list_append(done, {'s': s, 'n': e - s}) ELSE done END, list_transform(range(cuts), lambda k: {'s': pos + k * 2000, 'n': 2000}))
  FROM (SELECT w.*, ns[i + 1] AS n, s IS NOT NULL AND size + ns[i + 1] > 2000 AS flush, CASE WHEN ns[i + 1] > 2000 THEN (ns[i + 1] - 1) // 2000 ELSE 0 END AS cuts FROM w JOIN q USING (doc_id) WHERE i < len(ns)) x),
 f AS (SELECT w.doc_id, q.t, list_append(done, {'s': s, 'n': e - s}) AS p FROM w JOIN q ON q.doc_id = w.doc_id AND i = len(ns) UNION ALL SELECT doc_id, t, [{'s': 0, 'n': length(t)}] FROM d WHERE length(t) <= 2000),
 g AS (SELECT doc_id, unnest(range(len(p))) AS segment_index, unnest(list_transform(p, lambda x: substr(t, x.s + 1, x.n))) AS segment FROM f)"""


def _paragraphs(spark, d):
    """Documents whose lines are paragraphs, in segments of 2000 characters."""
    return tx.paragraph_segments(DOCS(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id")


@query("t18_paragraph_segments", _FOLD + " SELECT doc_id, segment_index, length(segment) AS n_chars, sha256(segment) AS hash FROM g")
def t18_paragraphs(spark, d):
    return _paragraphs(spark, d).select("doc_id", F.col("segment_index").cast("long").alias("segment_index"), F.length("segment").cast("long").alias("n_chars"), F.sha2("segment", 256).alias("hash"))


@query("t19_segment_totals", _FOLD + " SELECT count(*) AS segments, CAST(sum(length(segment)) AS BIGINT) AS total_chars, count(*) FILTER (segment_index = 1) AS split_docs FROM g")
def t19_totals(spark, d):
    s = _paragraphs(spark, d)
    return s.agg(F.count("*").alias("segments"), F.sum(F.length("segment")).alias("total_chars"), F.count_if(F.col("segment_index") == 1).alias("split_docs"))


#: What a release must not hold; the first rule names the private files of a project.
LEAKS = [
    ("private-marker", r"(?i)private-notes|working-copy|unreleased\.jsonl"),
    ("long-run", r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}][^\x{00}-\x{7f}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\n\r\t ]{100,}"),
    ("openrouter_key", r"sk-or-v1-[A-Za-z0-9_-]{16,}"),
    ("generic_api_key", r"(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['\"][A-Za-z0-9_-]{20,}['\"]"),
    ("bearer", r"Bearer\s+[A-Za-z0-9._-]{25,}"),
    ("cookie", r"(?i)(?:set-cookie|cookie)\s*[:=]\s*['\"][^'\"]{30,}['\"]"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github_pat", r"ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}"),
    ("osm", r"(?i)openstreetmap\.org|tile\.openstreetmap"),
    ("mapbox", r"(?i)mapbox\.com"),
    ("google", r"(?i)maps\.google|googleapis\.com/maps"),
    ("carto", r"(?i)basemaps\.cartocdn|carto\.(?:com|org)"),
    ("esri", r"(?i)arcgisonline\.com"),
    ("bing", r"(?i)bing\.com/maps|virtualearth"),
    ("stamen", r"(?i)stamen\.com|stamentiles"),
    ("thunderforest", r"(?i)thunderforest\.com"),
    ("here", r"(?i)hereapi|heremaps"),
]
LARGE = 5 * 1024 * 1024
# files: documents and pages under a path; some hold a planted leak
_PLANTED = {1: "see Unreleased.jsonl", 2: "key sk-or-v1-0123456789abcdefghij", 3: "API-KEY = 'abcdefghijklmnopqrst_1'", 4: "Bearer abcdefghij.klmnopqrst-uvwxyz", 5: "-----BEGIN RSA PRIVATE KEY-----", 6: "https://TILE.openstreetmap.org/1", 7: "maps.google and api.mapbox.com", 8: "\u6f22" * 120, 9: "ghp_" + "a1" * 20}
_FILES = "(SELECT CASE doc_id % 50 WHEN 12 THEN 'data/private/' WHEN 13 THEN 'raw/' WHEN 14 THEN 'a/raw/' WHEN 15 THEN 'a/b/raw/' ELSE 'docs/' END || doc_id || CASE doc_id % 50 WHEN 2 THEN '.png' ELSE '.txt' END AS path, text || CASE doc_id % 50 " + " ".join(f"WHEN {k + (k == 2) * 20} THEN ' " + v.replace("'", "''") + "'" for k, v in _PLANTED.items()) + " ELSE '' END AS text FROM documents UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages)"


@query("t16_release_scan", f"WITH f AS (SELECT * FROM {_FILES} x WHERE text IS NOT NULL), r(rule, pat) AS (VALUES " + ", ".join("('{}', '{}')".format(n, p.replace("'", "''")) for n, p in LEAKS) + f") SELECT path, rule FROM f, r WHERE NOT regexp_matches(path, '\\.(png|jpg|jpeg|webp|gif|ico|woff|woff2)$') AND regexp_matches(text, pat) UNION ALL SELECT path, 'size' FROM f WHERE strlen(text) > {LARGE} UNION ALL SELECT path, 'private-path' FROM f WHERE starts_with(path, 'data/private') OR list_contains(string_split(path, '/')[1:2], 'raw')")
def t16_release(spark, d):
    """Every file of a release against all rules: private names, long unbroken runs, secrets, remote hosts; size; path."""
    k = F.col("doc_id") % 50
    folder = F.when(k == 12, "data/private/").when(k == 13, "raw/").when(k == 14, "a/raw/").when(k == 15, "a/b/raw/").otherwise("docs/")
    planted = F.lit("")
    for n, v in _PLANTED.items():
        planted = F.when(k == n + (n == 2) * 20, F.lit(" " + v)).otherwise(planted)
    files = DOCS(spark, d).select(F.concat(folder, F.col("doc_id").cast("string"), F.when(k == 2, ".png").otherwise(".txt")).alias("path"), F.concat("text", planted).alias("text"))
    files = files.union(read(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), "html")).filter("text is not null")
    picture = F.col("path").rlike(r"\.(png|jpg|jpeg|webp|gif|ico|woff|woff2)$")
    found = [F.when(~picture & F.col("text").rlike(p), n) for n, p in LEAKS]
    found.append(F.when(F.octet_length("text") > LARGE, "size"))
    found.append(F.when(F.col("path").startswith("data/private") | F.array_contains(F.slice(F.split("path", "/"), 1, 2), "raw"), "private-path"))
    return files.select("path", F.explode(F.array_compact(F.array(*found))).alias("rule"))


@query("t20_mention_excerpts", "WITH m AS (SELECT item_id, text AS needle FROM benchmark), h AS (SELECT m.item_id, doc_id, strpos(d.text, needle) AS pos, d.text, row_number() OVER (PARTITION BY m.item_id ORDER BY doc_id) AS rn FROM m JOIN documents d ON contains(d.text, needle)) SELECT item_id, doc_id, substr(text, CAST(greatest(1, pos - 80) AS BIGINT), 190) AS excerpt FROM h WHERE rn <= 3")
def t20(spark, d):
    needle = read(spark, d, "benchmark").select("item_id", F.col("text").alias("needle"))
    h = mt.mentions(DOCS(spark, d).select("doc_id", "text"), needle, "text", "needle")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))
    return h.withColumn("rn", rank).filter("rn <= 3").select("item_id", "doc_id", F.col("text").substr(F.greatest(F.lit(1), F.expr("locate(needle, text)") - 80), F.lit(190)).alias("excerpt"))


@query("t21_prompt_batches", "WITH n AS (SELECT doc_id, lang, substr(text, 1, 150) AS cut, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents) SELECT lang, CAST(floor(rn / 20) AS BIGINT) AS batch, count(*) AS n, sha256(string_agg(CAST(rn % 20 AS VARCHAR) || ': ' || cut, chr(10) ORDER BY rn)) AS prompt_hash FROM n GROUP BY 1, 2")
def t21(spark, d):
    x = numbered(DOCS(spark, d).select("doc_id", "lang", F.substring("text", 1, 150).alias("cut")), ["doc_id"], by=["lang"], name="rn", start=0)
    x = x.withColumn("line", F.concat((F.col("rn") % 20).cast("string"), F.lit(": "), F.col("cut"))).withColumn("batch", F.floor(F.col("rn") / 20))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda s: s["line"]), "\n")
    return x.groupBy("lang", "batch").agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("prompt_hash"))


@query("t22_response_check", "WITH r AS (SELECT conv_id, count(*) AS want, count(*) FILTER (length(text) > 10) AS got FROM conversations GROUP BY 1), l AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown' END AS label FROM conversations) SELECT conv_id, turn, label FROM l JOIN r USING (conv_id) WHERE want = got")
def t22(spark, d):
    c = read(spark, d, "conversations")
    ok = c.groupBy("conv_id").agg(F.count("*").alias("want"), F.count_if(F.length("text") > 10).alias("got")).filter("want = got").select("conv_id")
    return c.join(ok, "conv_id").select("conv_id", "turn", F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("unknown").alias("label"))


@query("t23_verdict_import", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'unknown_id' WHEN l.quality NOT IN (0, 1) THEN 'bad_label' WHEN l.quality = 0 AND l.toxic = 1 THEN 'conflict' ELSE 'ok' END AS reason FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 200) d USING (doc_id)) GROUP BY 1")
def t23(spark, d):
    ids = DOCS(spark, d).filter("n_chars > 200").select("doc_id", F.lit(1).alias("known"))
    x = read(spark, d, "labels").join(ids, "doc_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown_id").when(~F.col("quality").isin(0, 1), "bad_label").when((F.col("quality") == 0) & (F.col("toxic") == 1), "conflict").otherwise("ok")
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("t24_short_description", "SELECT conv_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 120) END AS description FROM (SELECT conv_id, min_by(text, length(text) * 1000 + turn) AS t FROM conversations GROUP BY conv_id)")
def t24(spark, d):
    t = F.min_by("text", F.length("text") * 1000 + F.col("turn"))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.substring(t, 1, 120).alias("description"))


@query("a2_length_distribution", f"SELECT lang, min({WC}) AS min_wc, max({WC}) AS max_wc, round(avg({WC}), 6) AS mean_wc, median({WC}) AS median_wc, quantile_cont({WC}, 0.25) AS q1, quantile_cont({WC}, 0.75) AS q3 FROM documents GROUP BY lang")
def a2(spark, d):
    w = DOCS(spark, d).select("lang", tx.word_count(F.col("text")).alias("wc"))
    return w.groupBy("lang").agg(F.min("wc").alias("min_wc"), F.max("wc").alias("max_wc"), F.round(F.avg("wc"), 6).alias("mean_wc"), F.percentile("wc", 0.5).alias("median_wc"), F.percentile("wc", 0.25).alias("q1"), F.percentile("wc", 0.75).alias("q3"))


@query("a3_length_histogram", f"SELECT CAST(floor({WC} / 500) * 500 AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (regexp_matches(text, '{IP}')) AS warned FROM documents GROUP BY 1")
def a3(spark, d):
    w = DOCS(spark, d).select((F.floor(tx.word_count(F.col("text")) / 500) * 500).alias("bucket"), F.col("text").rlike(IP).alias("w"))
    return w.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("w").alias("warned"))


@query("l8_shortest_warned", f"SELECT doc_id, {WC} AS wc FROM documents WHERE regexp_matches(text, '{IP}') ORDER BY wc, doc_id LIMIT 8")
def l8(spark, d):
    return DOCS(spark, d).filter(F.col("text").rlike(IP)).select("doc_id", tx.word_count(F.col("text")).alias("wc")).orderBy("wc", "doc_id").limit(8)


@query("p1_stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR))) AS rn FROM documents) WHERE rn <= 10")
def p1(spark, d):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)))
    return DOCS(spark, d).select("doc_id", "lang", rank.alias("rn")).filter("rn <= 10").select("doc_id", "lang")


@query("p2_fill_to_minimum", "WITH s AS (SELECT doc_id FROM documents WHERE n_chars < 80), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR))) AS rn FROM documents ANTI JOIN s USING (doc_id)) SELECT doc_id FROM s UNION ALL SELECT doc_id FROM r WHERE rn <= greatest(0, 60 - (SELECT count(*) FROM s))")
def p2(spark, d):
    docs = DOCS(spark, d).select("doc_id", "n_chars")
    s = docs.filter("n_chars < 80").select("doc_id")
    order = F.sha2(F.concat(F.lit("9:"), F.col("doc_id").cast("string")), 256)
    rest = docs.join(s, "doc_id", "left_anti").select("doc_id", order.alias("o")).orderBy("o").limit(60)
    room = s.agg(F.greatest(F.lit(0), 60 - F.count("*")).alias("room"))
    ranked = rest.withColumn("rn", F.row_number().over(Window.orderBy("o")))  # 60 rows at most
    return s.union(ranked.join(F.broadcast(room), F.col("rn") <= F.col("room")).select("doc_id"))


@query("p3_review_packet", "SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || '|' || substr(text, 1, 500) || '|' || right(text, 500)) AS packet FROM documents")
def p3(spark, d):
    packet = F.concat_ws("|", F.col("doc_id").cast("string"), F.substring("text", 1, 500), F.expr("right(text, 500)"))
    return DOCS(spark, d).select("doc_id", F.sha2(packet, 256).alias("packet"))


@query("flagship_source_report", f"""WITH w AS (SELECT doc_id, lang, source, {WC} AS wc, text, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents), m AS (SELECT median(wc) AS med FROM w)
 SELECT lang, source, count(*) AS n_docs, count(*) FILTER (doc_id <> first_id) AS duplicates, count(*) FILTER (wc < 0.55 * med) AS outliers, count(*) FILTER (CAST(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS DOUBLE) / greatest(1, wc) < 0.5) AS odd_script, median(wc) AS median_wc FROM w, m GROUP BY lang, source""")
def flagship(spark, d):
    w = DOCS(spark, d).select("doc_id", "lang", "source", tx.word_count(F.col("text")).alias("wc"), F.coalesce(F.sha2("text", 256), F.lit("none")).alias("h"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("latin"))
    first = w.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")  # only texts that recur travel
    w = mt.salted(w.join(F.broadcast(w.agg(F.percentile("wc", 0.5).alias("med")))), first, ["h"], F.col("doc_id"), "left")
    return w.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("doc_id") != F.col("first_id")).alias("duplicates"), F.count_if(F.col("wc") < 0.55 * F.col("med")).alias("outliers"), F.count_if(F.col("latin") / F.greatest(F.lit(1), F.col("wc")) < 0.5).alias("odd_script"), F.percentile("wc", 0.5).alias("median_wc"))
