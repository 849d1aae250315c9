"""Consecutive numbers in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept
from .match import salted


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number", start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of the columns ``order`` (whose values are unique within
    ``by``), within each value of ``by`` or over all rows. Rows are dealt to tasks by ranges of ``by`` and ``order``, so a large
    group is spread over many; each task numbers its own rows, and what the ranges before it have of the same group is added."""
    by = by or []
    parts = kept(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    # a row for each group of a range: a running sum over ranges within a group, or over all ranges
    before = F.coalesce(F.sum("_n").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    for c in by:  # null groups meet as well
        offsets = offsets.withColumn(f"_{c}", F.coalesce(F.to_json(F.struct(c)), F.lit(""))).drop(c)
        local = local.withColumn(f"_{c}", F.coalesce(F.to_json(F.struct(c)), F.lit("")))
    met = salted(local, offsets, [*[f"_{c}" for c in by], "_part"], F.col("_local"))
    return met.withColumn(name, F.col("_before") + F.col("_local") + (start - 1)).drop("_before", "_local", "_part", *[f"_{c}" for c in by])


def numbered_lines(spark, path: str) -> DataFrame:
    """``file, line_no, value`` of text files, numbered from 1 within each file, blank lines included. A file's splits are
    read side by side: lines are counted in each, and what the splits before it have is added."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = kept(read, "lines")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("before", before).drop("n")
    met = salted(lines, splits, ["file", "block"], F.col("at"))
    return met.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")
