"""Queries: files written from the given tables and read again by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from placeweave.operators.graph import shared_dir
from placeweave.operators.numbering import numbered, numbered_lines
from placeweave.sources import files as fl

from .base import query, read
from .regions import _RING, rings


def folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def chunks(df, chunk: str, path: str) -> str:
    """A text file for each value of ``chunk``, its lines in the order of ``at``."""
    df.repartition(chunk).sortWithinPartitions(chunk, "at").select(chunk, "value").write.partitionBy(chunk).text(path)
    return path


def chunk_of(column: str):
    """The number of the file that a row comes from."""
    return F.regexp_extract(column, r"chunk=([0-9]+)", 1).cast("long")


_LINE = "CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'not json ' || c_custkey WHEN 2 THEN '[' || c_custkey || ']' ELSE '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' END"


def lines(spark, d) -> str:
    """A file of JSON lines for each 64 customers; some lines are blank, some no objects."""
    k = F.col("c_custkey") % 10
    text = F.when(k == 0, "").when(k == 1, F.concat(F.lit("not json "), F.col("c_custkey").cast("string"))).when(k == 2, F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit("]")))
    text = text.otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    c = read(spark, d, "customer").select(F.floor(F.col("c_custkey") / 64).alias("chunk"), F.col("c_custkey").alias("at"), text.alias("value"))
    return chunks(c, "chunk", folder(spark, "lines"))


@query("s1_json_lines", f"WITH l AS (SELECT c_custkey // 64 AS chunk, {_LINE} AS line, c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 64 ORDER BY c_custkey) AS line_no FROM customer) SELECT CASE WHEN starts_with(line, '{{') THEN 'row' ELSE 'bad' END AS kind, chunk, line_no, CASE WHEN starts_with(line, '{{') THEN c_name ELSE line END AS value FROM l WHERE line <> ''")
def s1(spark, d):
    """Rows and quarantined lines of JSON lines, with their line numbers."""
    path = lines(spark, d)
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    good, bad = fl.read_json_lines(spark, path, schema, line_numbers=True)
    rows = good.select(F.lit("row").alias("kind"), F.floor(F.col("id") / 64).alias("chunk"), F.col("_line_no").alias("line_no"), F.col("name").alias("value"))
    return rows.union(bad.select(F.lit("bad"), chunk_of("file"), "line_no", "value"))


@query("s16_file_manifest", f"WITH l AS (SELECT c_custkey // 64 AS chunk, string_agg({_LINE} || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY 1) SELECT chunk, strlen(content) AS bytes, sha256(content) AS sha256 FROM l")
def s16(spark, d):
    """Size and hash of each file."""
    m = fl.file_manifest(spark, lines(spark, d) + "/*/*.txt")
    return m.select(chunk_of("path").alias("chunk"), "bytes", "sha256")


@query("s3_features", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS lon, CAST(c_nationkey AS DOUBLE) AS lat, c_name AS name FROM customer")
def s3(spark, d):
    """Points of feature collections of fifty, and of single features."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").cast("string").alias("id"), geometry.alias("geometry"), F.struct(F.col("c_name").alias("name")).alias("properties"))
    c = read(spark, d, "customer").select(F.floor(F.col("c_custkey") / 50).alias("chunk"), "c_custkey", f.alias("f"))
    many = c.filter("chunk > 0").groupBy("chunk").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value")).withColumn("at", F.lit(0))
    one = c.filter("chunk = 0").select((F.col("c_custkey") + 1_000_000_000).alias("chunk"), F.to_json("f").alias("value"), F.lit(0).alias("at"))
    path = chunks(many.unionByName(one), "chunk", folder(spark, "features"))
    return fl.read_features(spark, path + "/*/*.txt").select("id", "lon", "lat", F.col("properties")["name"].alias("name"))


@query("s4_map_keyed", "SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey AS INTEGER) END AS key, CASE WHEN c_custkey % 9 = 0 THEN 'x' || c_custkey ELSE c_name END AS value FROM customer")
def s4(spark, d):
    """Objects whose keys are numbers; other keys are rejected."""
    key = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    c = read(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 40).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(key, "c_name"))).alias("m"))
    path = chunks(c.select("chunk", F.lit(0).alias("at"), F.to_json("m").alias("value")), "chunk", folder(spark, "maps"))
    good, bad = fl.read_map_keyed(spark, path + "/*/*.txt", "string")
    return good.select("key", "value").union(bad.select(F.lit(None).cast("int"), "k"))


@query("s5_wrapped_entries", "SELECT '2' AS version, 's' || c_nationkey AS season, c_custkey AS id, c_name AS title FROM customer")
def s5(spark, d):
    """Entries of versioned files."""
    c = read(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))).alias("entries"))
    text = F.to_json(F.struct(F.lit("2").alias("version"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("season"), "entries"))
    path = chunks(c.select((F.col("c_nationkey") * 1_000_000 + F.col("part")).alias("chunk"), F.lit(0).alias("at"), text.alias("value")), "chunk", folder(spark, "entries"))
    return fl.read_wrapped(spark, path + "/*/*.txt", "struct<id: bigint, title: string>")


@query("s7_polygon_rings", f"SELECT polygon, CASE WHEN ring % 10 = 1 AND polygon IN (SELECT polygon FROM {_RING} q WHERE ring % 10 = 0) THEN 1 ELSE 0 END AS ring_id, count(*) AS points, round(sum(lon), 6) AS lon_sum FROM {_RING} r WHERE NOT hole AND (polygon % 3 > 0 OR ring % 10 = 0) GROUP BY 1, 2")
def s7(spark, d):
    """Outer rings of polygons, of several polygons, and of collections of them; holes are left out."""
    v = rings(spark, d).groupBy("polygon", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"])).alias("p"))
    part = F.col("ring") % 10
    g = v.groupBy("polygon").agg(F.max(F.when(part == 0, F.col("p"))).alias("a"), F.max(F.when(part == 1, F.col("p"))).alias("b"), F.max(F.when(part == 2, F.col("p"))).alias("h"))
    first = F.when(F.col("a").isNotNull(), F.array_compact(F.array("a", "h"))).otherwise(F.array().cast("array<array<array<double>>>"))
    second = F.array_compact(F.array("b"))
    one = lambda c: F.struct(F.lit("Polygon").alias("type"), c.alias("coordinates"))
    kind = F.col("polygon") % 3
    text = F.when(kind == 0, F.to_json(one(first))).when(kind == 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.filter(F.array(first, second), lambda r: F.size(r) > 0).alias("coordinates"))))
    text = text.otherwise(F.to_json(F.struct(F.lit("GeometryCollection").alias("type"), F.array(one(first), one(second)).alias("geometries"))))
    path = chunks(g.select(F.col("polygon").alias("chunk"), F.lit(0).alias("at"), text.alias("value")), "chunk", folder(spark, "rings"))
    r = fl.read_rings(spark, path + "/*/*.txt", "file").withColumn("polygon", chunk_of("file")).filter("points is not null")
    total = F.aggregate("points", F.lit(0.0), lambda s, p: s + p[0])
    return r.select("polygon", "ring_id", F.size("points").cast("long").alias("points"), F.round(total, 6).alias("lon_sum"))


@query("s9_sorted_sink", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def s9(spark, d):
    """JSON lines in key order over all files: read in the order of files and lines, the keys rise."""
    path = folder(spark, "sorted")
    fl.write_sorted_lines(read(spark, d, "orders").select("o_orderkey"), path, "o_orderkey")
    back = numbered(numbered_lines(spark, path + "/*.json"), ["file", "line_no"], name="pos")
    return back.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "pos")
