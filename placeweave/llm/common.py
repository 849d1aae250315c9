"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the
    context's checkpoint folder; a local one is made only where neither is set and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as set it apart from ``columns`` (in any case)."""
    own = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in own:
            name = "_" + name
        out.append(name)
    return out


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def keyed_texts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` as a string, so that pandas never turns integers beside a null into floats, and ``text``, empty for null."""
    return df.select(F.col(key).cast("string").alias(key), text_or_empty().alias("text"))


def with_key(df: DataFrame, like: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with ``key`` cast back to its type in ``like``."""
    return df.withColumn(key, F.col(key).cast(like.schema[key].dataType))


def row_hash(df: DataFrame) -> Column:
    """A hash of the row's columns of plain types but ``text``, to tell rows with the same text apart."""
    own = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (NumericType, StringType, BinaryType, BooleanType, DateType, TimestampType)) and f.name != "text"]
    return F.xxhash64(*own) if own else F.lit(0)


#: Parts into which the rows of one key are dealt by a salted join.
SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key of ``left`` is dealt over SALTS parts by the column ``by``; the rows of
    ``right`` (one for each key, not hot) are repeated for each part."""
    (salt,) = spare([*left.columns, *right.columns], "_salt")
    salted = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return salted.join(copies, [*on, salt], how).drop(salt)
