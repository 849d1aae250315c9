"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns; all of them take time in proportion to the text. Each gets a
replacement made from a keyed hash of its normal form, so it is the same wherever the entity
occurs, in whatever notation; it keeps type, notation, check digit, and for names script and
gender. Given and family names are replaced apart, so that a person named with and without the
given name stays the same. Replacements that collide with each other or with an entity of the
corpus are made anew, from a larger space where the format allows it.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, spare, text_or_empty, written

_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "господин", "κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "госпожа", "κυρία")
_OPEN = ("Dr", "Prof")
_TITLES = sorted({t for own in (_MALE, _FEMALE, _OPEN) for x in own for t in (x, x.upper())}, key=lambda t: (-len(t), t))
_TITLE = rf"(?:{'|'.join(_TITLES)})\.? "
_FIRST = "".join(sorted({t[0] for t in _TITLES}))
#: Words before a name that its bearer says or fills in.
_INTRO = ("my name is ", "My name is ", "Name: ", "mein Name ist ", "Mein Name ist ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "mi nombre es ", "Mi nombre es ", "меня зовут ", "Меня зовут ", "με λένε ", "Με λένε ")
_CAP = r"\p{Lu}(?:[\p{Ll}'’-]++|\p{Lu}++(?![\p{Ll}]))"
#: What a title begins with is looked at first, and whether a word begins; else each place of a text would try them all.
_NAME = rf"(?=[{_FIRST}])(?<!\p{{L}}){_TITLE}{_CAP}(?: {_CAP})?(?!\p{{L}})|(?=\p{{Lu}})(?<= )(?<={'|'.join(_INTRO)}){_CAP}(?: {_CAP})?(?!\p{{L}})"
_CJK_NAME = r"[一-鿿]{2,3}(?:先生|女士|小姐)"
#: In this order: an earlier type wins where two match at one place. No group is repeated without bound, and runs
#: without bound begin at their first character only, so that a long text takes linear time and no stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex_secret": r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "name": f"{_NAME}|{_CJK_NAME}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No entity is found in a text without one of these.
CUE = rf"[0-9@]|(?=[{_FIRST}])(?<!\p{{L}}){_TITLE}|(?=[{''.join(sorted({t[0] for t in _INTRO}))}])(?<!\p{{L}})(?:{'|'.join(_INTRO)})|先生|女士|小姐"
DIGIT_TYPES = ("ssn", "card", "phone")
#: Syllables of made-up names by script; a given name's ending tells its gender.
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha ka ke ki la le li lo ma me mi mo na ne ni pa ra re ro sa se ta te ti to va ve vi za".split(),
    "cyrillic": "ба бо ва ве га да де за ка ко ла ле ли ма ме ми на не ни па ра ре ро са се та те ти".split(),
    "greek": "βα γα δα θα κα κο λα λε μα με να νε πα ρα ρο σα σε τα τε φα".split(),
    "cjk": list("安白博晨德东凡方海和华嘉建江康林明宁平青瑞山思天文晓新雪雅永"),
}
ENDINGS = {"latin": ("n", "na"), "cyrillic": ("н", "на"), "greek": ("ς", "να")}
#: Attempts after which a replacement may be longer by one syllable, sign or letter.
GROWS = 3
#: Attempts for formats of fixed length; the others find a free replacement before.
ATTEMPTS = 200
#: Setting of the session that holds the secret key of the surrogates.
KEY_SETTING = "spark.placeweave.surrogate.key"


def secret_key(spark: SparkSession) -> str:
    """The session's key; without one a key that is made up for this run, so that nobody can make the replacements again."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = entity.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("name")


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, f"^{_TITLE}", 0)


def parts_of(kind: Column, entity: Column) -> Column:
    """What is replaced as a whole and makes two mentions the same, as structs ``kind, core, gender``: digits alone, a
    lower-case form, a name's family part after its given part. Gender is m, f, or empty where the title doesn't tell."""
    title = F.regexp_replace(_title(entity), r"\.? $", "")
    of = lambda own: title.isin(*own, *[x.upper() for x in own])
    gender = F.when(of(_MALE) | entity.rlike("先生$"), "m").when(of(_FEMALE) | entity.rlike("(?:女士|小姐)$"), "f").otherwise("")
    words = F.split(F.lower(F.substring(entity, F.length(_title(entity)) + 1, F.length(entity))), " ")
    part = lambda k, c, g: F.struct(k.alias("kind"), c.alias("core"), g.alias("gender"))
    none = F.lit("")
    family = part(F.lit("family"), F.element_at(words, -1), none)
    name = F.when(F.size(words) > 1, F.array(part(F.lit("given"), words[0], gender), family)).otherwise(F.array(family))
    cjk = F.array(part(F.lit("cjk"), F.regexp_replace(entity, "(?:先生|女士|小姐)$", ""), gender))
    core = F.when(kind.isin(*DIGIT_TYPES), F.regexp_replace(entity, "[^0-9]", "")).when(kind == "email", F.lower(entity)).otherwise(entity)
    return F.when(entity.rlike(f"^{_CJK_NAME}$"), cjk).when(kind == "name", name).otherwise(F.array(part(kind, core, none)))


def _number(stream: Column, k: Column | int) -> Column:
    """k-th pseudo-random number (0 to 65535) of a hex stream of 256 digits."""
    at = F.pmod((F.lit(k) if isinstance(k, int) else k) * 4, F.lit(256)) + 1
    return F.conv(stream.substr(at, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str | list[str], n: Column) -> Column:
    own = list(letters)
    return F.element_at(F.array(*[F.lit(x) for x in own]), (F.pmod(n, F.lit(len(own))) + 1).cast("int"))


def _letters(stream: Column, n: int) -> Column:
    return F.concat(F.lit(""), *[_pick("abcdefghijklmnopqrstuvwxyz", _number(stream, 63 - k)) for k in range(n)])


def _by_char(text: Column, stream: Column, keep_from: Column, keep_to: Column, hexes: bool = False) -> Column:
    """Each letter and digit replaced within its class, other characters and those outside the span as they are."""

    def one(c, i):
        n = _number(stream, i)
        digit = F.pmod(n, F.lit(10)).cast("string")
        lower = F.lit("abcdef" if hexes else "abcdefghijklmnopqrstuvwxyz").substr(F.pmod(n, F.lit(6 if hexes else 26)) + 1, F.lit(1))
        fresh = F.when(c.rlike("[1-9]"), (F.pmod(n, F.lit(9)) + 1).cast("string")).when(c == "0", digit).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), F.upper(lower)).otherwise(c)
        return F.when((i >= keep_from) & (i < keep_to), fresh).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""

    def one(c, i):
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(core: Column, stream: Column) -> Column:
    """Same first digit; a valid number stays valid."""
    draft = _by_char(core, stream, F.lit(1), F.length(core) - 1)
    body = draft.substr(F.lit(1), F.length(core) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.concat(body, F.when(_luhn(core) == 0, check).otherwise(F.pmod(check + 1, F.lit(10))).cast("string"))


def _name(kind: Column, core: Column, gender: Column, stream: Column, more: int) -> Column:
    """Made-up syllables in the script of the name, ``more`` of them than usual; a given name ends by gender."""
    script = F.when(core.rlike(r"\p{IsCyrillic}"), "cyrillic").when(core.rlike(r"\p{IsGreek}"), "greek").when(core.rlike(r"\p{IsHan}"), "cjk").otherwise("latin")

    def word(name: str, n: int) -> Column:
        return F.concat(*[_pick(SYLLABLES[name], _number(stream, k)) for k in range(n)])

    out = None
    for name in SYLLABLES:
        if name == "cjk":
            made = F.when(F.length(core) == 2, word(name, 2 + more)).otherwise(word(name, 3 + more))
        else:
            male, female = ENDINGS[name]
            end = F.when(gender == "m", male).when(gender == "f", female).otherwise(_pick([male, female], _number(stream, 63)))
            made = F.when(kind == "given", F.concat(word(name, 2 + more), end)).otherwise(word(name, 4 + more))
        out = F.when(script == name, made) if out is None else out.when(script == name, made)
    return out.otherwise(core)


def surrogate(kind: Column, core: Column, gender: Column, attempt: int, key: str) -> Column:
    """The replacement of a normal form at an attempt."""
    more = min(attempt // GROWS, 40)
    seed = F.concat_ws("\x1f", F.lit(key), kind, gender, core, F.lit(str(attempt)))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{k}")), 256) for k in range(4)])
    octet = lambda k: (F.pmod(_number(stream, k), F.lit(254)) + 1).cast("string")
    mail_end = F.length(core) - F.length(F.regexp_extract(core, r"\.[a-z]{2,}$", 0))
    return (
        F.when(kind == "email", F.concat(_letters(stream, more), _by_char(core, stream, F.lit(0), mail_end)))
        .when(kind == "ip", F.concat_ws(".", *[octet(k) for k in range(4)]))
        .when(kind == "access_key", F.concat(F.lit("AKIA"), _by_char(core, stream, F.lit(4), F.lit(99)).substr(F.lit(5), F.lit(16))))
        .when(kind == "hex_secret", _by_char(core, stream, F.lit(0), F.lit(999), hexes=True))
        .when(kind == "card", _card(core, stream))
        .when(kind == "phone", _by_char(core, stream, F.when(F.length(core) > 10, F.length(core) - 10).otherwise(0), F.lit(99)))
        .when(kind == "ssn", _by_char(core, stream, F.lit(0), F.lit(99)))
        .otherwise(_name(kind, core, gender, stream, more))
    )


def in_notation(kind: Column, entity: Column, made: Column) -> Column:
    """The replacement written as the mention is: its separators, title and case. ``made`` are its parts."""
    one = made[0]

    def digit(state, c):
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(state["text"], F.when(is_digit, one.substr(state["at"] + 1, F.lit(1))).otherwise(c)).alias("text"),
            (state["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"),
        )

    digits = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), digit)["text"]
    cased = F.array_join(F.zip_with(F.split(entity, ""), F.split(one, ""), lambda c, m: F.when(c.rlike("[A-Z]"), F.upper(m)).otherwise(m)), "")
    cjk = F.concat(one, F.regexp_extract(entity, "(?:先生|女士|小姐)$", 0))
    title = _title(entity)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    names = F.zip_with(words, made, lambda w, m: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(m)).otherwise(F.initcap(m)))
    name = F.when(entity.rlike(f"^{_CJK_NAME}$"), cjk).otherwise(F.concat(title, F.array_join(names, " ")))
    return F.when(kind.isin(*DIGIT_TYPES), digits).when(kind == "email", cased).when(kind == "name", name).otherwise(one)


def mentions(docs: DataFrame) -> DataFrame:
    """``key`` (md5 of the whole text), ``pos``, ``entity``, ``kind``, ``parts`` of each entity of each different text."""
    own = docs.select(text_or_empty().alias("text")).filter(F.col("text").rlike(CUE))
    own = own.select(F.md5("text").alias("key"), F.regexp_extract_all("text", F.lit(ENTITY), 0).alias("found")).filter("size(found) > 0")
    own = own.groupBy("key").agg(F.first("found").alias("found")).select("key", F.posexplode("found").alias("pos", "entity"))
    own = own.withColumn("kind", kind_of(F.col("entity")))
    return own.withColumn("parts", parts_of(F.col("kind"), F.col("entity")))


def entity_parts(found: DataFrame) -> DataFrame:
    """A row for each part of the mentions: ``key, pos, at, kind, core, gender``."""
    return found.select("key", "pos", F.posexplode("parts").alias("at", "part")).select("key", "pos", "at", "part.*")


def mapping(found: DataFrame, key: str) -> DataFrame:
    """``kind, core, made``: one replacement for each part of an entity (rows ``kind, core, gender``), no two alike and
    none a part of the corpus. One whose mentions disagree on gender has an open one."""
    cores = found.groupBy("kind", "core").agg(F.min(F.nullif("gender", F.lit(""))).alias("g0"), F.max(F.nullif("gender", F.lit(""))).alias("g1"))
    cores = written(cores.select("kind", "core", F.when(F.col("g0") == F.col("g1"), F.col("g0")).otherwise("").alias("gender")), "entities")
    taken = cores.select("kind", F.col("core").alias("made"))
    waiting, done = cores, []
    for attempt in range(ATTEMPTS):
        tried = waiting.withColumn("made", surrogate(F.col("kind"), F.col("core"), F.col("gender"), attempt, key))
        winner = tried.groupBy("kind", "made").agg(F.min("core").alias("core"))
        used = reduce(DataFrame.unionByName, [taken, *[d.select("kind", "made") for d in done]])
        won = written(winner.join(used, ["kind", "made"], "left_anti").select("kind", "core", "made"), "surrogates")
        done.append(won)
        waiting = written(waiting.join(won, ["kind", "core"], "left_anti"), "waiting")
        if not waiting.limit(1).count():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"no free number of a fixed format after {ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with each entity in ``text`` replaced, and ``n_entities``. Without ``key``, see ``secret_key``.

    Texts without entities, null and empty ones come back as they are, as do an empty table and all other
    columns (one named ``n_entities`` is replaced). Repeated rows get equal texts; rows are never dropped."""
    names = [c for c in docs.columns if c != "n_entities"]
    id, new, pieces = spare(names, "id", "new", "pieces")
    found = written(mentions(docs), "mentions")
    parts = entity_parts(found)
    made = salted_join(parts.drop("gender"), mapping(parts, key or secret_key(docs.sparkSession)), ["kind", "core"], F.col("key"))
    made = made.groupBy("key", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "made")))["made"].alias("made"))
    fresh = found.join(made, ["key", "pos"]).select("key", F.struct("pos", in_notation(F.col("kind"), F.col("entity"), F.col("made")).alias("new")).alias("one"))
    fresh = fresh.groupBy("key").agg(F.array_sort(F.collect_list("one"))["new"].alias(new)).withColumnRenamed("key", id)
    cued = F.coalesce(F.col("text").rlike(CUE), F.lit(False))
    has = F.when(cued, F.col("text").rlike(ENTITY)).otherwise(False)
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    plain = own.filter(~has).withColumn("n_entities", F.lit(0).cast("long"))
    hit = own.filter(has).withColumn(id, F.md5("text")).join(fresh, id)
    hit = hit.withColumn(pieces, F.split("text", ENTITY, -1))
    text = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = hit.withColumn("text", text).withColumn("n_entities", F.size(new).cast("long")).select(*[F.col(f"`{c}`") for c in names], "n_entities")
    return plain.unionByName(out)


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
