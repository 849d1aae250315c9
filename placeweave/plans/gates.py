"""Queries: constraint tables and release gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeweave.operators import match as mt
from placeweave.operators.rules import Rule, violations

from .base import STORY, query, read, story

RULES = [Rule("p_name", "required"), Rule("p_brand", "enum", ("Brand#11", "Brand#12", "Brand#13")), Rule("p_size", "min", 5), Rule("p_size", "max", 45), Rule("p_name", "max_length", 9), Rule("p_type", "pattern", "^[A-Z]+"), Rule("p_retailprice", "max", 990.0)]
SQL = {
    "p_name.required": ("p_name IS NULL", "p_name"), "p_brand.enum": ("p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')", "p_brand"), "p_size.min": ("p_size < 5", "p_size"),
    "p_size.max": ("p_size > 45", "p_size"), "p_name.max_length": ("length(p_name) > 9", "p_name"), "p_type.pattern": ("NOT regexp_matches(p_type, '^[A-Z]+')", "p_type"), "p_retailprice.max": ("p_retailprice > 990.0", "p_retailprice"),
}
ALL = "(" + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS rule, CAST({v} AS VARCHAR) AS value FROM part WHERE {c}" for n, (c, v) in SQL.items()) + ")"


@query("q1_violations", f"SELECT 'part' AS dataset, CAST(p_partkey AS VARCHAR) AS row_id, rule, value FROM {ALL} v")
def q1(spark, d):
    return violations(read(spark, d, "part"), "part", "p_partkey", RULES)


@query("q2_two_per_row", f"SELECT CAST(p_partkey AS VARCHAR) AS row_id, rule FROM {ALL} v QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rule) <= 2")
def q2(spark, d):
    rn = F.row_number().over(Window.partitionBy("row_id").orderBy("rule"))
    return q1(spark, d).withColumn("rn", rn).filter("rn <= 2").select("row_id", "rule")


@query("q3_inference_checks", f"SELECT event_id, CASE WHEN k IS NULL THEN 'evidence' WHEN conf < 0.05 THEN 'confidence' WHEN chapter > 28 THEN 'range' END AS problem FROM {STORY} s WHERE k IS NULL OR conf < 0.05 OR chapter > 28")
def q3(spark, d):
    p = F.when(F.col("k").isNull(), "evidence").when(F.col("conf") < 0.05, "confidence").when(F.col("chapter") > 28, "range")
    return story(spark, d).select("event_id", p.alias("problem")).filter("problem is not null")


@query("q4_orphan_edges", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 48)")
def q4(spark, d):
    ok = read(spark, d, "part").filter("p_size < 48").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").select("l_partkey").distinct().join(ok, "l_partkey", "left_anti")


@query("q5_manifest_counts", "SELECT source, count(*) AS actual, CAST(50 AS BIGINT) AS declared, count(*) = 50 AS ok FROM documents GROUP BY source")
def q5(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("actual")).select("source", "actual", F.lit(50).cast("long").alias("declared"), (F.col("actual") == 50).alias("ok"))


@query("q6_provisional_gate", "SELECT count(*) FILTER (quality = 0) AS open_reviews, count(*) FILTER (quality = 0) > 0 AS banner_needed, count(*) FILTER (toxic = 1) = 0 AS strict_pass FROM labels")
def q6(spark, d):
    return read(spark, d, "labels").agg(F.count_if(F.col("quality") == 0).alias("open_reviews"), (F.count_if(F.col("quality") == 0) > 0).alias("banner_needed"), (F.count_if(F.col("toxic") == 1) == 0).alias("strict_pass"))


@query("q7_uniqueness", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def q7(spark, d):
    return read(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


@query("q8_tier_rules", "WITH t AS (SELECT c_nationkey AS id, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) SELECT a.id, count(*) FILTER (b.lo <= a.lo AND b.hi >= a.hi) AS inside FROM t a JOIN t b ON a.id <> b.id GROUP BY a.id")
def q8(spark, d):
    t = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    other = mt.sized(t.select(F.col("id").alias("oid"), F.col("lo").alias("olo"), F.col("hi").alias("ohi")))  # one row per nation
    return t.join(other, F.col("id") != F.col("oid")).groupBy("id").agg(F.count_if((F.col("olo") <= F.col("lo")) & (F.col("ohi") >= F.col("hi"))).alias("inside"))
