"""Components, closures and edge checks on edge tables, by iterated joins over written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder. A local one
    is made only where neither is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame, label: str = "graph") -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts into which the neighbours of one node are dealt when they meet its smallest neighbour.
PARTS = 8


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each edge with the smallest node ``m`` around its ``node``; a hub's edges are dealt over PARTS."""
    least = edges.groupBy(node).agg(F.least(F.col(node), F.min(other)).alias("m"))
    dealt = edges.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int"))
    return dealt.join(least.withColumn("_part", F.explode(F.array(*[F.lit(k) for k in range(PARTS)]))), [node, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of undirected edges ``a, b``. Alternating stars: each node hangs its larger
    neighbours on the smallest node around it, then its smaller neighbours and itself, until every node hangs on its
    component's smallest. Rounds grow with the logarithm of a component's size, a round's edges never outnumber the first ones."""
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
        both = now.select("a", "b").union(now.select("b", "a"))  # large star: over all neighbours
        large = _least(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = _least(large, "a", "b")  # small star: over the smaller ones
        small = least.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        now = kept(small, "edges")
    return nodes.join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def closure(links: DataFrame) -> DataFrame:
    """Ends of a functional map ``a -> b`` by pointer doubling: ``a, root``. Nodes on a cycle are left out; a
    node that leads into a cycle ends where it enters it. What still moves after as many doublings as the
    longest chain could need shows a cycle, whose nodes are then taken out."""
    step = kept(links.filter("a <> b").groupBy("a").agg(F.min("b").alias("b")), "step")
    now = step
    for _ in range(step.count().bit_length() + 1):
        nxt = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        new = kept(now.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "closure")
        if not new.filter("moved").limit(1).count():
            return new.select("a", F.col("b").alias("root"))
        now = new.select("a", "b")
    return closure(step.join(_on_cycle(step), "a", "left_anti"))


def _on_cycle(step: DataFrame) -> DataFrame:
    """Nodes of a functional map that stand on a cycle: those that are still reached after as many steps as there are nodes.
    The map is doubled that often, and what it reaches is walked back round each cycle by its own image."""
    now = step.select("a", "b")
    for _ in range(step.count().bit_length()):  # 2^k steps, more than the longest way into a cycle
        nxt = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        now = kept(now.join(nxt, "b").select("a", F.col("c").alias("b")), "cycle")  # who runs out of the map drops out
    return now.select(F.col("b").alias("a")).distinct()


def redirect(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their roots, without loops and repeats."""
    x = edges.join(roots.withColumnRenamed("root", "ra"), "a", "left").join(roots.withColumnsRenamed({"a": "b", "root": "rb"}), "b", "left")
    return x.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
