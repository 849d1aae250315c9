"""Scalar column functions on names, hashes, positions and labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """NFKC form without outer white space; Spark has no built-in for it."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip())


FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９", "0123456789"


def strip_note(name: Column) -> tuple[Column, Column]:
    """(name, note) of ``name (note)`` in either width of bracket; note is empty if there is none."""
    pattern = r"^(.+?)[（(](.+?)[）)]$"
    note = F.regexp_extract(name, pattern, 2)
    return F.when(note != "", F.trim(F.regexp_extract(name, pattern, 1))).otherwise(name), note


def normal_name(name: Column) -> Column:
    """Without a bracketed part, digits in ASCII, no spaces or dots, lower case."""
    plain = F.regexp_replace(name, r"[（(][^）)]*[）)]", "")
    return F.lower(F.regexp_replace(F.translate(plain, FULL_DIGITS, HALF_DIGITS), r"[ .·]", ""))


def punctuation_free(name: Column) -> Column:
    return F.regexp_replace(name, r"[ .,_#·-]", "")


def variant_key(name: Column, same_from: str = "O0Il", same_to: str = "0011") -> Column:
    """Equivalent characters unified, brackets dropped."""
    return F.translate(F.regexp_replace(name, r"[()（）\[\]]", ""), same_from, same_to)


def particle_key(name: Column, particles: str = "[aeiou]") -> Column:
    return F.regexp_replace(F.lower(name), particles, "")


def anagram_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name, "")), "")


def slug(name: Column) -> Column:
    """ASCII snake case of at most 60 characters, else a hash."""
    ascii_slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(ascii_slug.rlike("[a-z0-9]"), F.substring(ascii_slug, 1, 60)).otherwise(F.concat(F.lit("ent_"), F.substring(F.sha1(name.cast("binary")), 1, 10)))


def generic_suffix(name: Column, words: list[str], most: int = 3) -> Column:
    """First listed word that ends the name with a stem of at most ``most`` characters before it."""
    out = None
    for w in words:
        hit = name.endswith(w) & (F.length(name) - len(w) <= most)
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out


def usable(name: Column, stop: list[str]) -> Column:
    return ((F.length(name) >= 2) | name.rlike("^[A-Za-z0-9]$")) & ~name.isin(*stop)


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 10))


def hash_mod(text: Column, m: int) -> Column:
    """A 256-bit hash modulo m, by Horner's rule over its hex digits."""
    digits = F.transform(F.split(F.sha2(text, 256), ""), lambda c: F.conv(c, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: (acc * 16 + x) % m)


def band(conf: Column) -> Column:
    return F.when(conf >= 0.9, "high").when(conf >= 0.7, "good").when(conf >= 0.5, "fair").otherwise("low")


def sort_key(given: Column, chapter: Column) -> Column:
    """The given key, else ``ch`` and at least three digits; longer numbers aren't cut."""
    padded = F.when(F.length(chapter.cast("string")) < 3, F.lpad(chapter.cast("string"), 3, "0")).otherwise(chapter.cast("string"))
    return F.coalesce(given, F.concat(F.lit("ch"), padded))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def short_label(name: Column, most: int = 18) -> Column:
    """Whole if short, else cut at a word."""
    cut = F.regexp_extract(F.substring(name, 1, most), r"^(.*) [^ ]*$", 1)
    return F.when(F.length(name) <= most, name).when(cut != "", cut).otherwise(F.substring(name, 1, most))


def edit_kind(a: Column, b: Column) -> Column:
    """sub, ins or del for names one edit apart, else null."""
    near = F.levenshtein(a, b, 1) == 1
    return F.when(near & (F.length(a) == F.length(b)), "sub").when(near & (F.length(a) < F.length(b)), "ins").when(near, "del")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
