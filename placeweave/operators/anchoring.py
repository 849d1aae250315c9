"""Places for what is only known by name: inside a named place, or among the places of the same chapters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept
from .match import mentions, salted


def parents(places: DataFrame, resolved: DataFrame, by_name: int = 3, sure: int = 3, least: int = 2, cues: tuple[str, ...] = (), near: int = 6) -> DataFrame:
    """``place_id, parent, via`` of those ``places`` (``place_id, name, description``) that lie in one of ``resolved``
    (``name, rank``; one row for each name): the longest name of ``by_name`` characters or more inside its own name, else the
    longest in its description, where names shorter than ``sure`` only count with a cue at most ``near`` characters before or
    behind their first mention. Ties: the smallest rank."""
    known = resolved.select(F.col("name").alias("parent"), "rank").filter(F.length("parent") >= min(least, by_name))
    own = places.select("place_id", "name", "description")
    longest = F.struct(F.length("parent").alias("size"), (-F.col("rank")).alias("back"))
    inside = mentions(own, known.filter(F.length("parent") >= by_name), "name", "parent").filter("parent <> name")
    inside = inside.groupBy("place_id").agg(F.max_by("parent", longest).alias("parent")).withColumn("via", F.lit("name"))
    inside = kept(inside, "parents")
    said = mentions(own.join(inside, "place_id", "left_anti"), known.filter(F.length("parent") >= least), "description", "parent")
    at, n = F.instr("description", F.col("parent")), F.length("parent")
    start = F.greatest(F.lit(1), at - near)
    around = F.col("description").substr(start, at + n + near - start)
    cue = F.lit(False)
    for word in cues:
        cue = cue | F.contains(around, F.lit(word))
    said = said.filter((n >= sure) | cue).groupBy("place_id").agg(F.max_by("parent", longest).alias("parent"))
    return inside.unionByName(said.withColumn("via", F.lit("description")))


def ring_offset(key: Column, ring_m: Column, per_lon: float, per_lat: float) -> tuple[Column, Column]:
    """Degrees from a centre to a point that a hash of ``key`` chooses within a ring."""
    h = F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    angle = F.pmod(h, F.lit(3600)) / 3600 * (2 * math.pi)
    r = ring_m * (0.45 + 0.55 * F.pmod(F.shiftright(h, 12), F.lit(1000)) / 1000)
    return r * F.cos(angle) / per_lon, r * F.sin(angle) / per_lat


def anchored(lost: DataFrame, resolved: DataFrame, region: Column, centre: tuple[float, float], per_lon: float, per_lat: float, small_m: float = 90.0, large_m: float = 420.0, **how) -> DataFrame:
    """``place_id, source, parent, precision, lon, lat`` of each of ``lost`` (``place_id, name, description, chapters``):
    beside its parent, with the parent's precision; else round the middle of the ``resolved`` places (``place_id, name, lon, lat,
    precision, chapters``) of its chapters that lie in the region, one count for each chapter in common; else round ``centre``.
    Chapters meet as sums, so a chapter of many places costs a row."""
    names = resolved.groupBy("name").agg(F.min(F.struct("place_id", "lon", "lat", "precision")).alias("p")).select("name", F.col("p.place_id").alias("rank"), F.col("p.lon").alias("plon"), F.col("p.lat").alias("plat"), F.col("p.precision").alias("pprec"))
    names = kept(names, "names")
    found = parents(lost, names.select("name", "rank"), **how)
    x = lost.select("place_id").join(salted(found, names.withColumnRenamed("name", "parent"), ["parent"], F.col("place_id")), "place_id", "left")
    sums = resolved.filter(region).select(F.explode("chapters").alias("chapter"), "lon", "lat").groupBy("chapter").agg(F.sum("lon").alias("sx"), F.sum("lat").alias("sy"), F.count("*").alias("n"))
    there = lost.select("place_id", F.explode("chapters").alias("chapter"))
    middle = salted(there, sums, ["chapter"], F.col("place_id")).groupBy("place_id").agg((F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"))
    x = x.join(middle, "place_id", "left")
    has = F.col("parent").isNotNull()
    dx, dy = ring_offset(F.col("place_id"), F.when(has, small_m).otherwise(large_m), per_lon, per_lat)
    source = F.when(has, F.concat(F.lit("parent-"), F.col("via"))).when(F.col("mx").isNotNull(), "chapter").otherwise("default")
    lon, lat = F.coalesce("plon", "mx", F.lit(centre[0])) + dx, F.coalesce("plat", "my", F.lit(centre[1])) + dy
    return x.select("place_id", source.alias("source"), "parent", F.when(has, F.col("pprec")).otherwise("fictional").alias("precision"), lon.alias("lon"), lat.alias("lat"))
