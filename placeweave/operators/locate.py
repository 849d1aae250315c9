"""Places for events by tiers of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions import names as nm

from .graph import kept
from .match import mentions, salted


def district_of(texts: DataFrame, districts: DataFrame) -> DataFrame:
    """``text, district`` of those texts (``text``) that name a district (``district, rank``), both without punctuation and
    spaces: an equal one, else the longest that the text holds or that holds the text (ties: the smallest rank)."""
    t = texts.filter("text is not null").distinct().withColumn("t", nm.punctuation_free(F.col("text"))).filter("t <> ''")
    d = districts.withColumn("dn", nm.punctuation_free(F.col("district"))).filter("dn <> ''")
    t = kept(t, "texts")
    holds = mentions(t, d, "t", "dn").select("text", "t", "district", "rank", "dn")
    held = mentions(d, t.select("text", "t"), "dn", "t").select("text", "t", "district", "rank", "dn")
    order = F.struct((F.col("t") == F.col("dn")).alias("same"), F.length("dn").alias("size"), (-F.col("rank")).alias("back"))
    return holds.union(held).groupBy("text").agg(F.max_by("district", order).alias("district"))


def match_events(events: DataFrame, index: DataFrame, districts: DataFrame) -> DataFrame:
    """``event_id, tier, place, place_id`` for each event (``event_id, chapter, name, claim``; ids in reading order):
    1 a place of its name, 2 the longest place name in its texts, 3 the first place of the district that its name or else its
    claim names (without such a place the district itself, place_id null), 4 the place most often named in its chapter (the first
    one of each event counts; ties: the place counted first), 5 none. ``index`` has ``place, place_id``, one row for each name."""
    e = events.select("event_id", "chapter", F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("claim", F.lit("")).alias("claim"))
    e = kept(e.withColumn("text", F.concat_ws(" ", "name", "claim")), "events")
    own = index.select("place", "place_id")
    exact = salted(e.select("event_id", F.col("name").alias("place")), own, ["place"], F.col("event_id")).select("event_id", F.lit(1).alias("tier"), "place", "place_id")
    hits = kept(mentions(e.select("event_id", "chapter", "text"), own, "text", "place").select("event_id", "chapter", "place", "place_id"), "hits")
    longest = hits.groupBy("event_id").agg(F.max(F.struct(F.length("place").alias("size"), (-F.col("place_id")).alias("back"), "place", "place_id")).alias("b")).select("event_id", F.lit(2).alias("tier"), "b.place", "b.place_id")
    found = kept(exact.union(longest), "found")
    left = kept(e.join(found.select("event_id").distinct(), "event_id", "left_anti"), "left")
    named = kept(district_of(left.select(F.col("name").alias("text")).union(left.select(F.col("claim").alias("text"))), districts), "districts")
    by_name = named.select(F.col("text").alias("name"), F.col("district").alias("by_name"))
    by_claim = named.select(F.col("text").alias("claim"), F.col("district").alias("by_claim"))
    d = salted(salted(left, by_name, ["name"], F.col("event_id"), "left"), by_claim, ["claim"], F.col("event_id"), "left")
    d = d.select("event_id", F.coalesce("by_name", "by_claim").alias("district")).filter("district is not null")
    spot = mentions(own, d.select("district").distinct(), "place", "district").groupBy("district").agg(F.min(F.struct("place_id", "place")).alias("p"))
    near = salted(d, spot, ["district"], F.col("event_id"), "left").select("event_id", F.lit(3).alias("tier"), F.coalesce("p.place", "district").alias("place"), F.col("p.place_id").alias("place_id"))
    first = hits.groupBy("event_id", "chapter").agg(F.min(F.struct("place_id", "place")).alias("p"))
    often = first.groupBy("chapter", "p.place", "p.place_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    mode = often.groupBy("chapter").agg(F.max(F.struct("n", (-F.col("first")).alias("back"), "place", "place_id")).alias("b"))
    there = salted(left, mode.filter("chapter is not null"), ["chapter"], F.col("event_id")).select("event_id", F.lit(4).alias("tier"), "b.place", "b.place_id")
    none = e.select("event_id", F.lit(5).alias("tier"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("long").alias("place_id"))
    best = found.union(near).union(there).union(none).groupBy("event_id").agg(F.min(F.struct("tier", "place", "place_id")).alias("b"))
    return best.select("event_id", "b.tier", "b.place", "b.place_id")
