"""Joins of the selection pipeline: overrides, key checks, lines by position, resuming, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def restricted(accuracy: DataFrame, scores: DataFrame | None, id: str = "group_id") -> DataFrame:
    """Accuracy of scored groups, with the score; of all groups, with nulls, where there are no scores."""
    if scores is None:
        return accuracy.withColumn("score", F.lit(None).cast("double"))
    return accuracy.join(scores.select(id, "score"), id)


def truth_override(rows: DataFrame, truth: DataFrame, id: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the truth of the problem set, and those that it doesn't hold."""
    return rows.drop(column).join(truth.select(id, column), id), rows.join(truth, id, "left_anti")


def key_difference(left: DataFrame, right: DataFrame, id: str) -> DataFrame:
    """One row: numbers of missing and unknown keys and the first ten of each."""
    a, b = left.select(id).distinct().withColumn("l", F.lit(1)), right.select(id).distinct().withColumn("r", F.lit(1))
    both = a.join(b, id, "full_outer").where("l is null or r is null").withColumn("kind", F.when(F.col("r").isNull(), "unknown").otherwise("missing"))
    counts = both.groupBy("kind").agg(F.count("*").alias("n"))
    firsts = both.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy(id))).where("k <= 10").groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(id)), lambda x: x.cast("string")), ",").alias("first"))
    return counts.join(firsts, "kind")


def by_position(scores: DataFrame, lines: DataFrame, id: str = "group_id", line: str = "line") -> DataFrame:
    """Each score's line by number; null where there is none."""
    return scores.join(lines, scores[id] == lines[line], "left")


def unprocessed(rows: DataFrame, done: DataFrame, id: str) -> DataFrame:
    return rows.join(done.select(id), id, "left_anti")


def column_union(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """The columns of both batches; columns of both must be equal, NaN being NaN, else the query fails."""
    shared = [c for c in b.columns if c in a.columns and c != index]
    right = b.select(index, *(F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in b.columns if c != index))
    joined = a.join(right, index)
    same = F.lit(True)
    for c in shared:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return joined.where(F.assert_true(same, F.lit("columns of one name differ")).isNull()).drop(*(f"__{c}" for c in shared))


def first_name(wanted: DataFrame, have: DataFrame, candidates: Column, key: str = "name") -> DataFrame:
    """(key, found): the first of each row's candidate names that ``have`` (name) lists."""
    options = wanted.select(key, F.posexplode(candidates).alias("place", "option"))
    return options.join(have.select(F.col("name").alias("option")).distinct(), "option").groupBy(key).agg(F.min_by("option", "place").alias("found"))


def pairs_within(df: DataFrame, group: str, order: str, keep: list[str]) -> DataFrame:
    """All i < j of a group, for groups whose size the sampling fixes (a handful of responses per prompt)."""
    a = df.select(group, F.col(order).alias("i"), *(F.col(c).alias(f"{c}_i") for c in keep))
    b = df.select(group, F.col(order).alias("j"), *(F.col(c).alias(f"{c}_j") for c in keep))
    return a.join(b, group).where("i < j")


def other_class_mean(df: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """Adds the mean of ``value`` over the group's rows of the other class; null where there is none."""
    w = W.partitionBy(group)
    yes, no = F.col(flag), ~F.col(flag)
    mean = lambda on: F.try_divide(F.sum(F.when(on, F.col(value)).otherwise(0.0)).over(w), F.count_if(on).over(w).cast("double"))
    return df.withColumn("other_mean", F.when(yes, mean(no)).otherwise(mean(yes)))
