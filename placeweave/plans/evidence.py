"""Queries: ranked place inference from evidence in texts, and merges over a closure.

A document stands for a place: its first word is the name, its text the description, and the sources of the documents
that share its name are its chapters. The words of the benchmark items are the gazetteer; an item is an anchor whose
names are its long words. Names are matched as whole words, so each rule is an equi-join on words, prefixes or parts of a name.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.operators import graph as gr
from placeweave.operators import match as mt
from placeweave.operators.graph import kept

from .base import hash_point, query, read, sql_point

#: Least letters of a gazetteer word, an area and an anchor's name; ends of words that are roads or too general.
WORD, AREA, ANCHOR, GENERAL = 4, 6, 8, "tion"
MARKER, BASE, CUES = "in", "the", "in|at|by|from"
#: Cue words count this near to a mention, in characters.
NEAR = 18
#: Rules in order of strength, with their confidence.
RULES = [("EXPLICIT", 0.75), ("NAME-PLACE", 0.90), ("BLOCK", 0.88), ("CONTAIN", 0.80), ("ANCHOR-MEMBER", 0.72), ("DESC-PLACE", 0.65), ("DISTRICT", 0.55)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str):
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)


def subjects(spark, d) -> DataFrame:
    """place_id, name, words, source; documents without a word have no name and no evidence."""
    x = read(spark, d, "documents").select(F.col("doc_id").alias("place_id"), "source", words_of("text").alias("words"))
    return x.filter("size(words) > 0").withColumn("name", F.col("words")[0])


def gazetteer(spark, d) -> DataFrame:
    """word, lon, lat."""
    g = read(spark, d, "benchmark").select(F.explode(F.array_distinct(words_of("text"))).alias("word")).distinct().filter(F.length("word") >= WORD)
    lon, lat = hash_point(F.col("word"))
    return g.select("word", lon.alias("lon"), lat.alias("lat"))


def areas(g: DataFrame) -> DataFrame:
    return g.filter((F.length("word") >= AREA) & ~F.endswith("word", F.lit(GENERAL)))


def anchor_names(spark, d) -> DataFrame:
    """word, anchor: long words of the items."""
    x = read(spark, d, "benchmark").select(F.col("item_id").alias("anchor"), F.explode(F.array_distinct(words_of("text"))).alias("word"))
    return x.filter(F.length("word") >= ANCHOR)


def centroids(names: DataFrame) -> DataFrame:
    """anchor, lon, lat: the middle of its names' points."""
    lon, lat = hash_point(F.col("word"))
    return names.groupBy("anchor").agg(F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))


def chapters(s: DataFrame) -> DataFrame:
    """name, source: the chapters of each name."""
    return s.select("name", "source").distinct()


def companions(s: DataFrame, first: DataFrame) -> DataFrame:
    """name, anchor: the first anchor of which another name occurs in a chapter of this name. A chapter only keeps
    its first anchor, and the first one by another name; chapters are few and large, so their names are dealt."""
    here = chapters(s)
    known = here.join(mt.sized(first), F.col("name") == F.col("word")).select("source", F.struct("anchor", "word").alias("hit"))
    one = known.groupBy("source").agg(F.min("hit").alias("one"))
    two = mt.salted(known, one, ["source"], F.col("hit.word")).filter("hit.word <> one.word").groupBy("source").agg(F.min("hit").alias("two"))
    hit = F.when(F.col("one.word") == F.col("name"), F.col("two.anchor")).otherwise(F.col("one.anchor"))
    return mt.salted(here, one.join(two, "source", "left"), ["source"], F.col("name")).groupBy("name").agg(F.min(hit).alias("together")).filter("together is not null")


class Evidence:
    """What the rules draw on; each part is made when a rule first asks for it."""

    def __init__(self, spark, d):
        self.s = kept(subjects(spark, d), "subjects")  # the texts' words, read by every rule
        self.gazetteer, self.names = gazetteer(spark, d), anchor_names(spark, d)

    @cached_property
    def middle(self) -> DataFrame:
        return centroids(self.names)

    @cached_property
    def first(self) -> DataFrame:
        return self.names.groupBy("word").agg(F.min("anchor").alias("anchor"))

    @cached_property
    def said(self) -> DataFrame:
        told = self.s.select("place_id", "name", F.posexplode("words").alias("pos", "word"))
        return told.groupBy("place_id", "name", "word").agg(F.min("pos").alias("pos"))

    @cached_property
    def in_text(self) -> DataFrame:
        return self.said.join(mt.sized(self.first), "word").groupBy("place_id", "name").agg(F.min("anchor").alias("anchor"))

    @cached_property
    def together(self) -> DataFrame:
        return companions(self.s, self.first)

    def has(self, word: str) -> DataFrame:
        return self.s.filter(F.array_contains("words", word)).select("place_id")

    def at_anchor(self, x: DataFrame) -> DataFrame:
        return x.join(mt.sized(self.middle), "anchor").select("place_id", F.col("anchor").cast("string").alias("target"), "lon", "lat")

    @staticmethod
    def at_word(x: DataFrame) -> DataFrame:
        return x.select("place_id", F.col("word").alias("target"), "lon", "lat")

    def explicit(self) -> DataFrame:
        return self.at_anchor(self.in_text.join(self.has(MARKER), "place_id", "left_semi"))

    def name_place(self) -> DataFrame:
        known = self.gazetteer.filter(~F.endswith("word", F.lit(GENERAL)) & F.col("lon").between(114.0, 114.4))
        return self.at_word(self.s.select("place_id", F.col("name").alias("word")).join(mt.sized(known), "word"))

    def block(self) -> DataFrame:
        letter = F.regexp_extract("name", "^([a-d])[nrt]", 1)
        block = self.s.select("place_id", "name", letter.alias("letter"), F.array_contains("words", BASE).alias("base")).filter("letter <> ''")
        block = block.join(self.together, "name", "left").filter("together is not null or base").withColumn("anchor", F.coalesce("together", F.lit(0)))
        step = (F.ascii("letter") - 97) * 0.0002
        target = F.concat_ws("/", F.col("anchor").cast("string"), F.upper("letter"))
        return block.join(mt.sized(self.middle.select("anchor", "lon", "lat")), "anchor").select("place_id", target.alias("target"), (F.col("lon") + step).alias("lon"), (F.col("lat") - step).alias("lat"))

    def contain(self) -> DataFrame:
        """The longest gazetteer word inside a name: looked up by runs of letters, so a name of any length is read once."""
        held = mt.mentions(self.s.select("place_id", "name"), self.gazetteer.filter(F.length("word") >= WORD), "name", "word").filter("word <> name")
        best = held.groupBy("place_id").agg(F.min(F.struct((-F.length("word")).alias("k"), "word", "lon", "lat")).alias("m"))
        return self.at_word(best.select("place_id", "m.word", "m.lon", "m.lat"))

    def anchor_member(self) -> DataFrame:
        longest = self.first.agg(F.max(F.length("word"))).first()[0] or 0
        n = F.least(F.length("name"), F.lit(longest))
        heads = self.s.select("place_id", "name").filter(n >= ANCHOR).withColumn("word", F.explode(F.transform(F.sequence(F.lit(ANCHOR), n), lambda k: F.col("name").substr(F.lit(1), k))))
        by_name = heads.join(mt.sized(self.first), "word").select("place_id", "anchor")
        backed = self.in_text.join(self.together, "name", "left").join(self.has(BASE).withColumn("base", F.lit(True)), "place_id", "left").filter("together is not null or base")
        return self.at_anchor(by_name.union(backed.select("place_id", "anchor")).groupBy("place_id").agg(F.min("anchor").alias("anchor")))

    def desc_place(self) -> DataFrame:
        first = self.said.join(mt.sized(areas(self.gazetteer)), "word").groupBy("place_id").agg(F.min(F.struct("pos", "word", "lon", "lat")).alias("m"))
        return self.at_word(first.select("place_id", "m.word", "m.lon", "m.lat"))

    def district(self) -> DataFrame:
        return self.at_word(covered(self.s, areas(self.gazetteer)))


def rules(spark, d, *wanted: str) -> dict[str, DataFrame]:
    """``place_id, target, lon, lat`` of each rule that is asked for, or of all."""
    e = Evidence(spark, d)
    return {rule: getattr(e, rule.lower().replace("-", "_"))() for rule in wanted or [r for r, _ in RULES]}


def covered(s: DataFrame, a: DataFrame) -> DataFrame:
    """Relational division: places whose chapters an area's chapters all hold. Names and areas with equal sets of
    chapters are one class each, and a class of names meets the areas of its rarest chapter only."""
    sets = chapters(s).groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("mine"))
    known = sets.join(mt.sized(a.select(F.col("word").alias("name"))), "name", "left_semi")
    wide = known.groupBy(F.col("mine").alias("theirs")).agg(F.min("name").alias("word"))
    spread = wide.select(F.explode("theirs").alias("source"), "theirs", "word")
    rare = spread.groupBy("source").agg(F.count("*").alias("n"))
    # A chapter without an area rules its names out, so it counts as the rarest.
    classes = sets.join(mt.sized(a.select(F.col("word").alias("name"))), "name", "left_anti").select("mine").distinct()
    probe = classes.select("mine", F.explode("mine").alias("source")).join(rare, "source", "left")
    probe = probe.groupBy("mine").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "source")).alias("m")).select("mine", "m.source")
    hit = probe.join(spread, "source").filter(F.size(F.array_except("mine", "theirs")) == 0).groupBy("mine").agg(F.min("word").alias("word"))
    found = sets.join(mt.sized(a.select(F.col("word").alias("name"))), "name", "left_anti").join(hit, "mine").select("name", "word")
    return s.select("place_id", "name").join(found, "name").join(mt.sized(a), "word").select("place_id", "word", "lon", "lat")


EVIDENCE = f"""WITH s AS (SELECT doc_id AS place_id, source, words, words[1] AS name FROM (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS words FROM documents) q WHERE len(words) > 0),
 bw AS (SELECT DISTINCT item_id AS anchor, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) AS word FROM benchmark),
 g AS (SELECT word, {sql_point('word')} FROM (SELECT DISTINCT word FROM bw WHERE length(word) >= {WORD}) q),
 a AS (SELECT * FROM g WHERE length(word) >= {AREA} AND NOT ends_with(word, '{GENERAL}')),
 an AS (SELECT anchor, word FROM bw WHERE length(word) >= {ANCHOR}),
 mid AS (SELECT anchor, avg(lon) AS lon, avg(lat) AS lat FROM (SELECT anchor, {sql_point('word')} FROM an) q GROUP BY 1),
 told AS (SELECT place_id, name, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM s),
 intext AS (SELECT place_id, name, min(anchor) AS anchor FROM (SELECT DISTINCT place_id, name, word FROM told) q JOIN an USING (word) GROUP BY 1, 2),
 ch AS (SELECT DISTINCT name, source FROM s),
 tog AS (SELECT x.name, min(an.anchor) AS together FROM ch x JOIN ch y USING (source) JOIN an ON an.word = y.name WHERE x.name <> y.name GROUP BY 1),
 c AS (
 SELECT 1 AS rank, place_id, CAST(anchor AS VARCHAR) AS target, lon, lat FROM intext JOIN mid USING (anchor) WHERE place_id IN (SELECT place_id FROM s WHERE list_contains(words, '{MARKER}'))
 UNION ALL SELECT 2, place_id, word, lon, lat FROM s JOIN g ON g.word = s.name WHERE NOT ends_with(word, '{GENERAL}') AND lon BETWEEN 114.0 AND 114.4
 UNION ALL SELECT 3, place_id, anchor || '/' || upper(letter), lon + (ascii(letter) - 97) * 0.0002, lat - (ascii(letter) - 97) * 0.0002 FROM (SELECT place_id, regexp_extract(name, '^([a-d])[nrt]', 1) AS letter, coalesce(together, 0) AS anchor FROM s LEFT JOIN tog USING (name) WHERE together IS NOT NULL OR list_contains(words, '{BASE}')) q JOIN mid USING (anchor) WHERE letter <> ''
 UNION ALL SELECT * FROM (SELECT 4, place_id, word, lon, lat FROM s JOIN g ON contains(s.name, g.word) AND s.name <> g.word QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY length(word) DESC, word) = 1) q
 UNION ALL SELECT 5, place_id, CAST(anchor AS VARCHAR), lon, lat FROM (SELECT place_id, min(anchor) AS anchor FROM (SELECT place_id, anchor FROM s JOIN an ON starts_with(s.name, an.word) UNION ALL SELECT place_id, anchor FROM intext LEFT JOIN tog USING (name) WHERE together IS NOT NULL OR place_id IN (SELECT place_id FROM s WHERE list_contains(words, '{BASE}'))) q GROUP BY 1) q JOIN mid USING (anchor)
 UNION ALL SELECT * FROM (SELECT 6, place_id, word, lon, lat FROM told JOIN a USING (word) QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY pos) = 1) q
 UNION ALL SELECT 7, place_id, word, lon, lat FROM (SELECT place_id, min(word) AS word FROM s JOIN (SELECT x.name, y.name AS word FROM ch x JOIN ch y USING (source) WHERE y.name IN (SELECT word FROM a) AND x.name NOT IN (SELECT word FROM a) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM ch z WHERE z.name = x.name)) q USING (name) GROUP BY 1) q JOIN a USING (word)
 )"""
_CONF = "CASE rank " + " ".join(f"WHEN {k} THEN {conf}" for k, (_, conf) in enumerate(RULES, 1)) + " END"
_RULE = "CASE rank " + " ".join(f"WHEN {k} THEN '{rule}'" for k, (rule, _) in enumerate(RULES, 1)) + " END"
_POINT = "round(lon, 6) AS lon, round(lat, 6) AS lat"


def rated(spark, d) -> list[DataFrame]:
    found = rules(spark, d)
    return [found[rule].select("place_id", F.lit(rule).alias("rule"), "target", F.lit(conf).alias("conf"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")) for rule, conf in RULES]


@query("e8_rule_cascade", EVIDENCE + f" SELECT place_id, {_RULE} AS rule, target, CAST({_CONF} AS DOUBLE) AS conf, {_POINT} FROM c QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY rank) = 1")
def e8(spark, d):
    """The strongest rule with a hit for each place."""
    return mt.tiered(rated(spark, d), ["place_id"], [F.col("target")]).select("place_id", "rule", "target", "conf", "lon", "lat")


for _rank, (_rule, _) in enumerate(RULES, 1):

    @query(f"e8_rule_{_rule.lower().replace('-', '_')}", EVIDENCE + f" SELECT place_id, target, {_POINT} FROM c WHERE rank = {_rank}")
    def _one(spark, d, k=_rule):
        return rules(spark, d, k)[k].select("place_id", "target", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("e15_e16_best_and_apply", EVIDENCE + f", b AS (SELECT *, {_RULE} AS rule, CAST({_CONF} AS DOUBLE) AS conf FROM c QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {_CONF} DESC, rank) = 1) SELECT doc_id AS place_id, coalesce(rule, 'NONE') AS rule, CASE WHEN b.conf >= 0.7 AND b.lon BETWEEN 113.9 AND 114.4 THEN 'approximate' ELSE 'fictional' END AS precision FROM documents LEFT JOIN b ON b.place_id = doc_id")
def e15(spark, d):
    rows = [r.withColumn("rank", F.lit(k)) for k, r in enumerate(rated(spark, d), 1)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    b = mt.best(union, ["place_id"], [F.desc("conf"), F.col("rank")])
    x = read(spark, d, "documents").select(F.col("doc_id").alias("place_id")).join(b, "place_id", "left")
    return x.select("place_id", F.coalesce("rule", F.lit("NONE")).alias("rule"), F.when((F.col("conf") >= 0.7) & F.col("lon").between(113.9, 114.4), "approximate").otherwise("fictional").alias("precision"))


_CUE = f"(^|[^a-z])({CUES})([^a-z]|$)"


@query(
    "e12_resolved_context",
    EVIDENCE
    + f""", res AS (SELECT DISTINCT target AS word FROM c WHERE rank = 2),
 txt AS (SELECT doc_id AS place_id, translate(text, '{UPPER}', '{LOWER}') AS t FROM documents),
 hit AS (SELECT place_id, word, t, instr(t, word) AS p FROM (SELECT DISTINCT place_id, name, word FROM told) q JOIN res USING (word) JOIN txt USING (place_id) WHERE name <> word),
 one AS (SELECT place_id, min(word) AS target FROM hit WHERE regexp_matches(substr(t, greatest(1, p - {NEAR}), p - greatest(1, p - {NEAR})) || ' ' || substr(t, p + length(word), {NEAR}), '{_CUE}') GROUP BY 1),
 tied AS (SELECT word, CAST(min(anchor) AS VARCHAR) AS target FROM an GROUP BY 1 HAVING count(DISTINCT anchor) = 1),
 two AS (SELECT place_id, min(target) AS target FROM s JOIN tied ON contains(s.name, tied.word) GROUP BY 1)
 SELECT place_id, coalesce(one.target, two.target) AS target, CAST(CASE WHEN one.target IS NOT NULL THEN 0.62 ELSE 0.55 END AS DOUBLE) AS conf FROM one FULL JOIN two USING (place_id)""",
)
def e12(spark, d):
    """Places whose text names a resolved place near a spatial cue, else whose name holds a name of exactly one anchor."""
    s = kept(subjects(spark, d), "subjects")
    resolved = rules(spark, d, "NAME-PLACE")["NAME-PLACE"].select(F.col("target").alias("word")).distinct()
    said = s.select("place_id", "name", F.explode(F.array_distinct("words")).alias("word")).join(mt.sized(resolved), "word").filter("name <> word")
    text = read(spark, d, "documents").select(F.col("doc_id").alias("place_id"), F.translate("text", UPPER, LOWER).alias("t"))
    hit = said.groupBy("place_id").agg(F.collect_set("word").alias("found")).join(text, "place_id").select("place_id", "t", F.explode("found").alias("word"))
    p = F.instr("t", F.col("word"))
    start = F.greatest(F.lit(1), p - NEAR)
    around = F.concat(F.col("t").substr(start, p - start), F.lit(" "), F.col("t").substr(p + F.length("word"), F.lit(NEAR)))
    one = hit.filter(around.rlike(_CUE)).groupBy("place_id").agg(F.min("word").alias("one"))

    tied = anchor_names(spark, d).groupBy("word").agg(F.min("anchor").cast("string").alias("target"), F.count_distinct("anchor").alias("n")).filter("n = 1").drop("n")
    two = mt.mentions(s.select("place_id", "name"), tied, "name", "word").groupBy("place_id").agg(F.min("target").alias("two"))
    return one.join(two, "place_id", "full").select("place_id", F.coalesce("one", "two").alias("target"), F.when(F.col("one").isNotNull(), 0.62).otherwise(0.55).alias("conf"))


MERGES = "(SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = CAST(floor(x.c_custkey / 3) AS BIGINT) AND y.c_mktsegment = x.c_mktsegment AND y.c_custkey <> x.c_custkey)"


@query("e18_e19_merge", f"WITH RECURSIVE l AS (SELECT * FROM {MERGES} q), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), t AS (SELECT a, b AS root FROM r WHERE b NOT IN (SELECT a FROM l)) SELECT coalesce(root, c_custkey) AS target, list_sort(list(DISTINCT c_name)) AS aliases, list_sort(list(DISTINCT c_nationkey)) AS chapters, count(*) AS n FROM customer LEFT JOIN t ON t.a = c_custkey GROUP BY 1")
def e18(spark, d):
    """Entities merged along chains of decisions: names and chapters go into the last of each chain, the others go."""
    c = read(spark, d, "customer")
    into = c.select(F.col("c_custkey").alias("b"), "c_mktsegment")
    links = c.select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 3).alias("b"), "c_mktsegment").join(into, ["b", "c_mktsegment"]).select("a", "b")
    x = c.join(gr.closure(links).withColumnRenamed("a", "c_custkey"), "c_custkey", "left")
    return x.groupBy(F.coalesce("root", "c_custkey").alias("target")).agg(F.array_sort(F.collect_set("c_name")).alias("aliases"), F.array_sort(F.collect_set("c_nationkey")).alias("chapters"), F.count("*").alias("n"))
