"""Dictionary, tier, band and grid joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

#: A dictionary of at most this many rows may be broadcast; a larger one is matched by a shared key.
BROADCAST_ROWS = 50_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count shows that it is small; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _grams(text: str, sizes: list[int]) -> Column:
    """Distinct runs of each of ``sizes`` characters. Characters are split off once: taking each run from the text would
    walk it from its start again and again."""

    def runs(c: Column) -> Column:
        parts = []
        for n in sizes:
            if n == 1:
                parts.append(c)
                continue
            at = F.sequence(F.lit(0), F.size(c) - n)
            parts.append(F.when(F.size(c) >= n, F.transform(at, lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(F.flatten(F.array(*parts)))

    return F.transform(F.array(F.split(text, "")), runs)[0]


#: Characters of the runs by which longer names are looked up; shorter names are looked up by themselves.
RUN = 3


def mentions(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Each row of ``texts`` with each row of ``names`` whose name its text holds. A name is looked up by that of
    its runs of three characters which the fewest texts have (a name of one or two characters by itself), so a text meets
    only names with such a run in common, whatever the sizes of both sides. Equal texts are searched once. Null texts and
    null or empty names meet nothing."""
    own = names.select(F.col(name).alias("_name")).filter(F.length("_name") > 0).distinct()
    sizes = [r["n"] for r in own.select(F.least(F.lit(RUN), F.length("_name")).alias("n")).distinct().orderBy("n").collect()]
    if not sizes:
        return texts.limit(0).join(names.limit(0))
    read = texts.select(F.col(text).alias("_text")).filter("_text is not null").distinct().withColumn("_h", F.md5("_text"))
    parts = own.select("_name", F.explode(F.when(F.length("_name") >= RUN, _grams("_name", [RUN])).otherwise(F.array("_name"))).alias("_g"))
    runs = read.select("_h", F.explode(_grams("_text", sizes)).alias("_g")).filter("_g <> ''")
    count = sized(parts.select("_g").distinct())
    frequent = runs.join(count, "_g").groupBy("_g").agg(F.count("*").alias("_n"))
    # a run that no text has rules its name out; else the rarest is the key
    keys = parts.join(frequent, "_g", "left").groupBy("_name").agg(F.count_if(F.col("_n").isNull()).alias("_none"), F.min_by("_g", F.struct("_n", "_g")).alias("_g")).filter("_none = 0")
    keys = kept(keys.select("_name", "_g"), "keys")
    found = runs.join(sized(keys), "_g").select("_h", "_name")
    held = kept(read.join(found, "_h").filter(F.contains("_text", "_name")).select("_h", "_name").distinct(), "held")
    rows = texts.withColumn("_h", F.md5(text))
    if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # few texts, however often they occur
        rows = rows.join(F.broadcast(held), "_h").drop("_h")
    else:
        by = F.xxhash64(*[F.col(f"`{c}`") for c, t in texts.dtypes if not t.startswith(("map", "variant"))])
        lists = held.groupBy("_h").agg(F.collect_set("_name").alias("_names"))
        rows = salted(rows, lists, ["_h"], by).withColumn("_name", F.explode("_names")).drop("_h", "_names")
    return rows.join(sized(names), F.col("_name") == names[name]).drop("_name")


#: Parts into which the rows of a key are dealt where one key may hold a large share of them.
SALTS = 8


def salted(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key of ``left`` is dealt over SALTS parts by the column ``by``; the rows of ``right``,
    of which no key has many, are repeated for each part."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


#: Rows of a key that stay together in ``dealt``.
TOGETHER = 20_000


def dealt(left: DataFrame, right: DataFrame, on: list[str], by: Column, most: int | None = None) -> DataFrame:
    """Inner equi-join in which keys of more than ``most`` (TOGETHER) rows in ``left`` are dealt into parts by the column
    ``by``; only their rows of ``right`` are repeated. ``left`` is read twice."""
    most = most or TOGETHER
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot = F.broadcast(kept(hot, "hot"))  # no more than one for each ``most`` rows
    parts = F.coalesce("_parts", F.lit(1))
    own = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copies = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return own.join(copies, [*on, "_part"]).drop("_part")


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order (which ends in a unique column)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def tiered(tiers: list[DataFrame], by: list[str], order: list[Column]) -> DataFrame:
    """Candidates of several tiers in order of strength (equal columns): the best of the strongest tier with a hit."""
    rows = [t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers, 1)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return best(out, by, [F.col("tier"), *order])


def band_join(left: DataFrame, right: DataFrame, on: str, k: int) -> DataFrame:
    """Rows whose integer ``on`` differ by at most k, as an equi-join on the widened left side; the right
    side's column becomes ``other_<on>``."""
    wide = left.withColumn("_at", F.explode(F.sequence(F.col(on) - k, F.col(on) + k)))
    return wide.join(right.withColumnRenamed(on, f"other_{on}"), F.col("_at") == F.col(f"other_{on}")).drop("_at")


def within(left: DataFrame, right: DataFrame, radius_m: float, distance, deg_lon: float, deg_lat: float, same: dict[str, str] | None = None) -> DataFrame:
    """Pairs of points within a radius: cells of the radius's size, the right side dealt to the nine
    cells around it, then the exact distance. Both sides have lon, lat; the right's become lon2, lat2. ``same`` names
    columns of the left side and those of the right that have to be equal to them."""
    cx, cy = F.floor(F.col("lon") / deg_lon), F.floor(F.col("lat") / deg_lat)
    a = left.withColumn("_x", cx).withColumn("_y", cy)
    b = right.withColumnsRenamed({"lon": "lon2", "lat": "lat2"})
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = b.withColumn("_x", F.explode(F.transform(near, lambda i: F.floor(F.col("lon2") / deg_lon) + i)))
    b = b.withColumn("_y", F.explode(F.transform(near, lambda i: F.floor(F.col("lat2") / deg_lat) + i)))
    b = b.withColumnsRenamed({y: x for x, y in (same or {}).items()})
    return a.join(b, [*(same or {}), "_x", "_y"]).drop("_x", "_y").withColumn("dist", distance).filter(F.col("dist") <= radius_m)
