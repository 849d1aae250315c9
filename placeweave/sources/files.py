"""Readers and writers: JSON lines, feature collections, map-keyed JSON, wrappers, ledgers, reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from placeweave.operators.numbering import numbered_lines


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = False, line_numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine). Blank lines are skipped but counted. Strict reading fails and names the first bad line; otherwise
    bad lines and values that aren't objects go to the quarantine with file, line number and text. Rows bear their line
    number as ``_line_no`` if asked for."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    wide = StructType([*schema.fields]).add("_corrupt_record", "string")
    parsed = lines.select("file", "line_no", "value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.trim("value").startswith("{")
    wrong = parsed.filter(bad).select("file", "line_no", "value")
    if strict:
        first = wrong.orderBy("file", "line_no").limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['file']}, line {first[0]['line_no']}: no JSON object")
    extra = [F.col("line_no").alias("_line_no")] if line_numbers else []
    return parsed.filter(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields], *extra), wrong


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Point features of collections and single features: ``id, lon, lat, properties`` (a map)."""
    point, props = "struct<type:string, coordinates:array<double>>", "map<string, string>"
    inner = f"struct<type:string, id:string, geometry:{point}, properties:{props}>"
    df = spark.read.schema(f"type string, id string, geometry {point}, properties {props}, features array<{inner}>").json(path, multiLine=True)
    one = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.col("geometry"), F.col("properties"))
    rows = df.select(F.explode(F.coalesce("features", F.array(one))).alias("f"))
    return rows.select("f.id", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), "f.properties")


def read_map_keyed(spark: SparkSession, path: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows ``key int, value``, rejected keys) of a JSON object whose keys are numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("k", "value"))
    key = F.expr("try_cast(k as int)")
    return rows.filter(key.isNotNull()).select(key.alias("key"), "value"), rows.filter(key.isNull()).select("k")


def read_wrapped(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of ``{version, season, entries}`` files."""
    return spark.read.schema(f"version string, season string, entries array<{entry}>").json(path, multiLine=True).select("version", "season", F.inline("entries"))


_JSON = json.JSONDecoder()


def first_json(text: str | None) -> str | None:
    """The first array that parses, else the first object that parses, anywhere in free text."""
    for sign, close in ("[]", "{}") if text else ():
        at, last = text.find(sign), text.rfind(close)
        while 0 <= at < last:  # nothing closes behind the last closing sign
            try:
                return text[at : _JSON.raw_decode(text, at)[1]]
            except (ValueError, RecursionError):
                at = text.find(sign, at + 1)
    return None


@F.pandas_udf(StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_json)


def write_sorted_lines(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in key order, part by part."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.json(path)


def to_features(df: DataFrame, id_col: str, lon: str, lat: str, props: list[str]) -> DataFrame:
    """One feature per line, to be written as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_col).cast("string").alias("id"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Newest wins: the rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_rings(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """Outer rings of Polygon, MultiPolygon and GeometryCollection files: ``ring_id, points`` (lon, lat pairs), and the
    file's path in the column ``file`` if it is named."""
    pair = "array<array<double>>"
    df = spark.read.text(path, wholetext=True)
    kind = F.get_json_object("value", "$.type")
    one = F.array(F.from_json(F.get_json_object("value", "$.coordinates"), f"array<{pair}>"))
    many = F.from_json(F.get_json_object("value", "$.coordinates"), f"array<array<{pair}>>")
    parts = F.from_json(F.get_json_object("value", "$.geometries"), f"array<struct<type:string, coordinates:array<{pair}>>>")
    inner = F.transform(F.filter(parts, lambda g: g["type"] == "Polygon"), lambda g: g["coordinates"])
    polygons = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(inner)
    name = [F.col("_metadata.file_path").alias(file)] if file else []
    return df.select(*name, F.posexplode(F.transform(F.filter(polygons, lambda p: F.size(p) > 0), lambda p: p[0])).alias("ring_id", "points"))
