"""Zones: seeds in place names, their members, centre and radius, and the merge of neighbouring zones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import greedy, match


@dataclass(frozen=True)
class ZoneRules:
    """Words that make a name a zone's, each with its kind, in order of strength; words of place in brackets;
    radii (metres) by kind where members give none; bounds of a radius and the largest gap of a merge."""

    words: tuple[tuple[str, str], ...]
    locatives: tuple[str, ...]
    radius: dict[str, float] = field(default_factory=dict)
    other_radius: float = 200.0
    merged_radius: float = 300.0
    bounds: tuple[float, float] = (80.0, 2000.0)
    gap: float = 3000.0
    margin: float = 1.15
    most_chapters: int = 50

    def kind(self, name: Column) -> Column:
        return reduce(lambda rest, w: F.when(F.contains(name, F.lit(w[0])), w[1]).otherwise(rest), reversed(self.words), F.lit(None).cast("string"))

    def seed(self, name: Column) -> Column:
        """The name up to its zone word, or null: where the word stands in brackets with a word of place, or where
        hardly anything comes before it. The first word of the list that occurs decides."""
        inner = F.regexp_extract(name, "[(（]([^)）]*)[)）]", 1)
        has = lambda words: reduce(lambda a, b: a | b, (F.contains(inner, F.lit(w)) for w in words), F.lit(False))
        core = F.lit(None).cast("string")
        for word, _ in reversed(self.words):
            end = F.locate(word, name) + len(word) - 1
            core = F.when(F.contains(name, F.lit(word)), F.when(end > len(word) + 1, name.substr(F.lit(1), end))).otherwise(core)
        return F.when(~(has([w for w, _ in self.words]) & has(self.locatives)), core)

    def first_word_end(self, name: Column) -> Column:
        """Where the zone word ends that ends first; 0 without one."""
        ends = [F.when(F.contains(name, F.lit(w)), F.locate(w, name) + len(w) - 1) for w, _ in self.words]
        return F.coalesce(F.least(*ends) if len(ends) > 1 else ends[0], F.lit(0))


def members(places: DataFrame, rules: ZoneRules) -> DataFrame:
    """``place_id, zone, assigned`` of ``places`` (``place_id, name``; ids give the order): a place whose name has a
    seed belongs to it; another to the first seed (by its first place) that its name holds."""
    own = places.select("place_id", "name", rules.seed(F.col("name")).alias("zone"))
    seeds = own.filter("zone is not null")
    first = seeds.groupBy(F.col("zone").alias("seed")).agg(F.min("place_id").alias("first"))
    held = match.mentions(own.filter("zone is null").select("place_id", "name"), first, "name", "seed")
    held = held.groupBy("place_id").agg(F.min_by("seed", "first").alias("zone"))
    return seeds.select("place_id", "zone", F.lit(0).alias("assigned")).unionByName(held.withColumn("assigned", F.lit(1)))


def shapes(member: DataFrame, places: DataFrame, rules: ZoneRules, distance: Callable[..., Column], radius: Column) -> DataFrame:
    """A row for each zone of ``member`` (``place_id, zone, assigned``): ``zone, first, lon, lat, radius, source, n,
    located, chapters, body``. Two members or more that aren't fictional give centre and radius; else the first
    member's place and ``radius`` do (a column over ``zone``). ``places`` has ``place_id, name, lon, lat, fictional, chapters``."""
    x = member.join(places, "place_id")
    real = ~F.col("fictional")
    order = F.struct("assigned", "place_id")
    g = x.groupBy("zone").agg(
        F.min("place_id").alias("first"), F.count("*").alias("n"), F.count_if(real).alias("located"), F.avg(F.when(real, F.col("lon"))).alias("lon_c"), F.avg(F.when(real, F.col("lat"))).alias("lat_c"),
        F.min_by("lon", order).alias("lon_1"), F.min_by("lat", order).alias("lat_1"), F.min_by("name", F.struct(F.length("name").alias("l"), order.alias("o"))).alias("body"),
    )
    by_members = F.col("located") >= 2
    g = g.select("zone", "first", "n", "located", "body", F.when(by_members, F.col("lon_c")).otherwise(F.col("lon_1")).alias("lon"), F.when(by_members, F.col("lat_c")).otherwise(F.col("lat_1")).alias("lat"))
    centre = g.select("zone", F.col("lon").alias("lon_c"), F.col("lat").alias("lat_c"))
    far = match.salted(x.filter(real).select("zone", "place_id", "lon", "lat"), centre, ["zone"], F.col("place_id"))
    far = far.groupBy("zone").agg(F.max(distance(F.col("lon"), F.col("lat"), F.col("lon_c"), F.col("lat_c"))).alias("far"))
    each = x.select("zone", F.explode("chapters").alias("chapter")).distinct().groupBy("zone").agg(F.array_sort(F.collect_list("chapter")).alias("chapters"))
    low, high = rules.bounds
    size = F.when(by_members, F.col("far") * rules.margin).otherwise(radius)
    out = g.join(far, "zone", "left").join(each, "zone", "left")
    return out.select(
        "zone", "first", "lon", "lat", F.least(F.lit(high), F.greatest(F.lit(low), size)).alias("radius"), F.when(by_members, "members").otherwise("default").alias("source"), "n", "located",
        F.slice(F.coalesce("chapters", F.array().cast("array<int>")), 1, rules.most_chapters).alias("chapters"), "body",
    )


def kind_radius(rules: ZoneRules, zone: str = "zone") -> Column:
    kind = rules.kind(F.col(zone))
    return reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), rules.radius.items(), F.lit(rules.other_radius))


def merges(zones: DataFrame, rules: ZoneRules, distance: Callable[..., Column], deg_lon: float, deg_lat: float) -> DataFrame:
    """``zone, centre``: in the order of ``first``, each zone that is still free takes the later free ones whose
    names share two characters or more at the start, without a zone word among what they share, and whose centres lie
    within the gap. ``deg_lon`` and ``deg_lat`` are the gap in degrees."""
    key = zones.select("zone", "first", "lon", "lat", F.substring("zone", 1, 2).alias("head"), F.col("zone").substr(F.lit(1), rules.first_word_end(F.col("zone"))).alias("cut")).filter(F.length("head") == 2)
    left = key.select(F.col("zone").alias("a"), "lon", "lat", "head", F.col("cut").alias("cut_a"))
    right = key.select(F.col("zone").alias("b"), "lon", "lat", F.col("head").alias("head2"), "cut")
    near = match.within(left, right, rules.gap, distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), deg_lon, deg_lat, {"head": "head2"})
    # what two names share holds a zone word just if they are equal up to the end of their first one
    pairs = near.filter((F.col("a") != F.col("b")) & ((F.length("cut_a") == 0) | (F.col("cut_a") != F.col("cut"))))
    return greedy.stars(zones.select(F.col("zone").alias("node"), F.col("first").alias("rank")), pairs.select("a", "b")).withColumnRenamed("node", "zone")


def merged_shapes(zones: DataFrame, member: DataFrame, places: DataFrame, merged: DataFrame, rules: ZoneRules, distance: Callable[..., Column]) -> DataFrame:
    """``centre, name, zones`` and the shape of each merged group; a zone that takes none keeps its own shape. The
    shortest name of a group is its name."""
    group = zones.select("zone", "first").join(merged, "zone").groupBy("centre").agg(F.count("*").alias("zones"), F.min_by("zone", F.struct(F.length("zone"), "first")).alias("name"))
    many = group.filter("zones > 1").select("centre")
    own = member.join(merged, "zone").join(many, "centre", "left_semi")
    # members come zone by zone, in the zones' order
    order = zones.select("zone", F.col("first").alias("zone_first"))
    own = own.join(order, "zone").select("place_id", F.col("centre").alias("zone"), F.struct("zone_first", "assigned").alias("assigned"))
    new = shapes(own, places, rules, distance, F.lit(rules.merged_radius))
    both = new.unionByName(zones.join(group.filter("zones = 1").select(F.col("centre").alias("zone")), "zone", "left_semi"))
    return group.join(both.withColumnRenamed("zone", "centre"), "centre")
