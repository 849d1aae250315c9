"""Registry of queries, and how the given tables stand in for documents, places, events and people."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Points: no table has coordinates, so a name's hash gives a place in a box, on both sides alike.
LON0, LAT0, SPAN_LON, SPAN_LAT = 113.85, 22.18, 0.6, 0.37


def hash_point(name) -> tuple:
    """(lon, lat) columns from a name's sha256."""
    h = F.sha2(name.cast("string"), 256)
    u = lambda k: F.conv(F.substring(h, k, 6), 16, 10).cast("long") / F.lit(16777216.0)
    return F.lit(LON0) + u(1) * SPAN_LON, F.lit(LAT0) + u(7) * SPAN_LAT


def sql_point(name: str) -> str:
    u = lambda k: f"(CAST(CAST('0x' || substr(sha256({name}), {k}, 6) AS BIGINT) AS DOUBLE) / 16777216.0)"
    return f"{LON0} + {u(1)} * {SPAN_LON} AS lon, {LAT0} + {u(7)} * {SPAN_LAT} AS lat"


def places(spark, d) -> DataFrame:
    """place_id, name, seg (kind), nation, score, lon, lat from customers."""
    lon, lat = hash_point(F.col("c_name"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("score"), lon.alias("lon"), lat.alias("lat"))


PLACES = f"(SELECT c_custkey AS place_id, c_name AS name, c_mktsegment AS seg, c_nationkey AS nation, c_acctbal AS score, {sql_point('c_name')} FROM customer)"


def anchors(spark, d) -> DataFrame:
    """anchor_id, name, nation, lon, lat from suppliers."""
    lon, lat = hash_point(F.col("s_name"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("anchor_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), lon.alias("lon"), lat.alias("lat"))


ANCHORS = f"(SELECT s_suppkey AS anchor_id, s_name AS name, s_nationkey AS nation, {sql_point('s_name')} FROM supplier)"


def story(spark, d) -> DataFrame:
    """event_id, chapter (day), person, title (type), value, conf (0 to 1), k (attribute) from events."""
    e = read(spark, d, "events")
    chapter = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    return e.select("event_id", chapter.alias("chapter"), F.col("user_id").alias("person"), F.col("event_type").alias("title"), "value", F.least(F.lit(1.0), F.col("value") / 100.0).alias("conf"), F.get_json_object("props", "$.k").cast("int").alias("k"))


STORY = "(SELECT event_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS chapter, user_id AS person, event_type AS title, value, least(1.0, value / 100.0) AS conf, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def metres(lon1, lat1, lon2, lat2, cos_lat: float = 0.9248, per_lon: float = 111320.0, per_lat: float = 110570.0):
    """Equirectangular distance; the cosine of the reference latitude is a parameter."""
    return F.sqrt(F.pow((lon1 - lon2) * (cos_lat * per_lon), F.lit(2)) + F.pow((lat1 - lat2) * per_lat, F.lit(2)))


def sql_metres(a: str, b: str) -> str:
    return f"sqrt(pow(({a}.lon - {b}.lon) * (0.9248 * 111320.0), 2) + pow(({a}.lat - {b}.lat) * 110570.0, 2))"
