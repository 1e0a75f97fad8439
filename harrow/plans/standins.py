"""Rollouts, vectors, chats and sample streams seen in the given tables.

The tables hold no rollouts, so orders stand for prompts and their lines for sampled responses. A price is divided by a
power of two, so that what is rounded to decimals later doesn't end in ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The order of an order's lines; (l_orderkey, l_linenumber) alone repeats.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

#: The same views for the SQL side, to be put before a query as WITH entries.
SQL = {
    "rollouts": """rollouts AS (SELECT l_orderkey AS group_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS sample_id,
  CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS reward,
  CAST(l_quantity AS BIGINT) AS length, l_returnflag = 'R' AS passed, l_returnflag || l_linestatus AS pred,
  -l_discount * 10 AS old_logp, -l_tax * 10 AS logp, l_extendedprice / 131072 AS value, l_quantity > 10 AS masked_in,
  'b' || CAST(l_suppkey % 4 AS VARCHAR) AS benchmark FROM lineitem)""",
    "coords": """coords AS (SELECT vec_id, label, i AS idx, CAST(embedding[i + 1] AS DOUBLE) AS x
  FROM embeddings, LATERAL (SELECT unnest(range(64)) AS i))""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, sample_id, reward, length, passed, pred, old_logp, logp, value, masked_in, benchmark) of each line."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE)) - 1).cast("long").alias("sample_id"),
        F.when(flag == "R", 1.0).when(flag == "A", 0.5).otherwise(0.0).alias("reward"),
        F.col("l_quantity").cast("long").alias("length"),
        (flag == "R").alias("passed"),
        F.concat("l_returnflag", "l_linestatus").alias("pred"),
        (-F.col("l_discount") * 10).alias("old_logp"),
        (-F.col("l_tax") * 10).alias("logp"),
        (F.col("l_extendedprice") / 131072).alias("value"),
        (F.col("l_quantity") > 10).alias("masked_in"),
        F.concat(F.lit("b"), (F.col("l_suppkey") % 4).cast("string")).alias("benchmark"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: its samples as a token sequence of rewards, values, masks and log-probabilities."""
    step = F.struct("sample_id", "reward", "value", F.col("masked_in").cast("int").alias("mask"), "old_logp", "logp")
    folded = rollouts(spark, sf_dir).groupBy("group_id").agg(F.array_sort(F.collect_list(step)).alias("t"))
    return folded.select("group_id", *(F.col(f"t.{c}").alias(c) for c in ("reward", "value", "mask", "old_logp", "logp")))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, idx, x): embeddings as long rows; label 0 is the validation set."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
