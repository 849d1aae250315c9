"""Structured Streaming twins of batch jobs: incremental cleaning, keyed dedup, upserts, ledger state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeweave.operators.text import CleanRules, clean, word_count


def clean_stream(docs: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """Stateless: arriving documents cleaned, with their length and a short flag."""
    out = clean(docs, rules)
    return out.withColumn("wc", word_count(F.col("clean_text"))).withColumn("short", F.col("wc") <= 100)


def dedup_stream(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark; later rows beyond it are dropped with their state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def ledger_stream(rows: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Last status per key, in update mode."""
    return rows.groupBy(key).agg(F.max_by(status, order).alias("last"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """What has arrived, written to Parquet; restartable by its checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions under ``folder`` whose write has succeeded, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(x.getPath().getParent().getName()[1:]) for x in found)


def _first_version(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """The version that a stream's first batch writes: behind those that ``folder`` has when the checkpoint is new; it is
    noted beside the checkpoint, so a restart finds the same number."""
    note = f"{checkpoint.rstrip('/')}-first-version"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{note}/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return int(spark.read.text(note).first()["value"])
    first = max(complete_versions(spark, folder), default=-1) + 1
    spark.range(1).select(F.lit(str(first)).alias("value")).write.mode("overwrite").text(note)
    return first


def upsert_available(df: DataFrame, key: str, order: str, folder: str, checkpoint: str) -> str:
    """Newest-wins table, a new version per batch under ``folder``. A version counts once its write has succeeded, and
    each batch starts from the last such version before it, so a restart goes on where the table stood, and a new checkpoint
    over an old table goes on behind its last version. Returns the path of the last version, or an empty string."""
    spark: SparkSession = df.sparkSession
    first = _first_version(spark, folder, checkpoint)

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        before = [v for v in complete_versions(spark, folder) if v < first + epoch]
        if before:
            both = spark.read.parquet(f"{folder}/v{before[-1]}").unionByName(new)
            new = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")
        new.write.mode("overwrite").parquet(f"{folder}/v{first + epoch}")

    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = complete_versions(spark, folder)
    return f"{folder}/v{done[-1]}" if done else ""


def scored(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Pluggable scorer hook: ``fn`` maps an iterator of pandas batches; no client is shipped."""
    return df.mapInPandas(fn, schema)
