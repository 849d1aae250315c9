"""Queries: streams over the given tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placeweave.operators.graph import kept
from placeweave.streaming import jobs

from .base import query, read


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        kept(spark.range(1), "probe")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    """A stream of a table's files; a table that is one file is given by its folder and name."""
    schema = read(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


@query("r1_clean_stream", "SELECT doc_id, CAST(length(regexp_replace(text, '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}', '', 'g')) - length(text) AS BIGINT) * -1 AS cut_address FROM documents")
def r1(spark, d):
    f = _folder(spark)
    jobs.run_available(jobs.clean_stream(_stream(spark, d, "documents")).select("doc_id", "cut_address", "wc", "short"), f"{f}/out", f"{f}/checkpoint")
    return spark.read.parquet(f"{f}/out").select("doc_id", "cut_address")


@query("r2_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def r2(spark, d):
    f = _folder(spark)
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.dedup_stream(events, ["user_id", "event_type"], "ts", "60 days")
    jobs.run_available(out.select("user_id", "event_type"), f"{f}/out", f"{f}/checkpoint")
    return spark.read.parquet(f"{f}/out")


@query("r3_upsert_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def r3(spark, d):
    f = _folder(spark)
    path = jobs.upsert_available(_stream(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", f"{f}/table", f"{f}/checkpoint")
    return spark.read.parquet(path).select("user_id", "event_id")


@query("r4_ledger_stream", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1")
def r4(spark, d):
    f = _folder(spark)
    state = jobs.ledger_stream(_stream(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")
    write = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{f}/out")
    state.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{f}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{f}/out").groupBy("o_custkey").agg(F.max_by("last", "epoch").alias("last"))


@query("scorer_hook", "SELECT event_id, value > 100 AS label FROM events")
def scorer(spark, d):
    def stub(batches):
        for pdf in batches:
            yield pdf.assign(label=pdf["value"] > 100)[["event_id", "label"]]

    return jobs.scored(read(spark, d, "events").select("event_id", "value"), stub, "event_id long, label boolean")
