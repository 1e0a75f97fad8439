"""Gradient alignment: dot products of candidate vectors with a validation vector.

Vectors are long rows (id, module, idx, x), so a gradient of any size spreads over the cluster and every
score is one partial aggregation. The validation side is one row per coordinate and joins on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-5


def module_of(name: Column) -> Column:
    """A parameter's module: its name up to the last dot, without a wrapper's prefix."""
    bare = F.regexp_replace(name, r"(^|\.)(_fsdp_wrapped_module|_orig_mod|module)\.", "$1")
    return F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.[^.]*$", "")).otherwise(bare)


def normalize(df: DataFrame, id: str = "id", x: str = "x", eps: float = EPS) -> DataFrame:
    """Every vector over its norm + eps."""
    return df.withColumn(x, F.col(x) / (F.sqrt(F.sum(F.col(x) * F.col(x)).over(W.partitionBy(id))) + eps))


def validation_vector(df: DataFrame, per_group: bool = False, id: str = "id", x: str = "x", coordinate: tuple[str, ...] = ("idx",)) -> DataFrame:
    """(coordinate, v): the rows' sum, or the sum of their normalized vectors, over its norm + eps."""
    rows = normalize(df, id, x) if per_group else df
    total = rows.groupBy(*coordinate).agg(F.sum(x).alias("v"))
    norm = total.agg((F.sqrt(F.sum(F.col("v") * F.col("v"))) + EPS).alias("norm"))
    return total.crossJoin(F.broadcast(norm)).select(*coordinate, (F.col("v") / F.col("norm")).alias("v"))


def scores(candidates: DataFrame, validation: DataFrame, mode: str = "sim", id: str = "id", x: str = "x", coordinate: tuple[str, ...] = ("idx",)) -> DataFrame:
    """(id, score): "sim" normalizes the candidate, "dot" doesn't, "norm" is its norm + eps alone. One pass:
    the dot product and the norm come from the same aggregation."""
    own = candidates.join(validation, list(coordinate), "left")
    norm = F.sqrt(F.sum(F.col(x) * F.col(x))) + EPS
    dot = F.coalesce(F.sum(F.col(x) * F.col("v")), F.lit(0.0))
    score = {"sim": dot / norm, "dot": dot, "norm": norm}[mode]
    return own.groupBy(id).agg(score.alias("score"))


def module_scores(candidates: DataFrame, validation: DataFrame, id: str = "id", x: str = "x", coordinate: tuple[str, ...] = ("idx",), module: str = "module") -> DataFrame:
    """(id, module, dot) of normalized candidates."""
    own = normalize(candidates, id, x).join(validation, list(coordinate))
    return own.groupBy(id, module).agg(F.sum(F.col(x) * F.col("v")).alias("dot"))


def top_modules(dots: DataFrame, k: int = 5, id: str = "id") -> DataFrame:
    """The ``k`` modules with the largest absolute dot of each id, by rank; ties by name."""
    order = W.partitionBy(id).orderBy(F.desc(F.abs("dot")), "module")
    return dots.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shortcut(scores: DataFrame, groups: DataFrame, id: str = "id") -> DataFrame:
    """Scores of 0 for groups all of whose advantages vanish. ``groups`` has id and zero_advantage."""
    return groups.join(scores, id, "left").select(id, F.when(F.col("zero_advantage"), 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def without_small(df: DataFrame, advantage: str = "advantage", least: float = 1e-3) -> DataFrame:
    """Rows whose advantage is not next to nothing."""
    return df.where(F.abs(advantage) >= least)


def scores_or_zero(groups: DataFrame, scores: DataFrame, id: str = "group_id") -> DataFrame:
    """(id, score) of all groups; 0 for those without any."""
    return groups.select(id).distinct().join(scores, id, "left").select(id, F.coalesce("score", F.lit(0.0)).alias("score"))


def optimizer_scaled(df: DataFrame, moments: DataFrame, coordinate: tuple[str, ...] = ("idx",), x: str = "x", eps: float = 1e-8) -> DataFrame:
    """Vectors over the root of the optimizer's second moment at their coordinate."""
    return df.join(moments, list(coordinate)).withColumn(x, F.col(x) / (F.sqrt("second") + eps)).drop("second")


def group_loss(tokens: DataFrame, group: str = "group_id") -> DataFrame:
    """Cross entropy weighted by advantage over all response tokens of a group."""
    return tokens.groupBy(group).agg((F.sum(F.col("ce") * F.col("advantage")) / F.sum("n_tokens")).alias("loss"))


def adamw_delta(grad: Column, m: Column, v: Column, step: int, lr: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> Column:
    """The step that AdamW takes for its gradient, without decay. ``step`` counts this one."""
    m1, v1 = beta1 * m + (1 - beta1) * grad, beta2 * v + (1 - beta2) * grad * grad
    return -lr / (1 - beta1**step) * m1 / (F.sqrt(v1) / (1 - beta2**step) ** 0.5 + eps)


def adamw_counterfactual(df: DataFrame, step: int, lr: float, decay: float = 0.01, amsgrad: bool = False, **betas: float) -> DataFrame:
    """Adds actual, marginal (less what no gradient would do) and full (with decay) steps to rows of
    param, grad, m and v."""
    if amsgrad:
        raise ValueError("AMSGrad keeps a state that these rows don't have")
    actual = adamw_delta(F.col("grad"), F.col("m"), F.col("v"), step, lr, **betas)
    still = adamw_delta(F.lit(0.0), F.col("m"), F.col("v"), step, lr, **betas)
    return df.withColumns({"actual": actual, "marginal": actual - still, "full": actual - lr * decay * F.col("param")})


def clip_coefficient(df: DataFrame, most: float = 1.0, x: str = "x") -> DataFrame:
    """(norm, coefficient) over all rows."""
    norm = F.sqrt(F.sum(F.col(x) * F.col(x)))
    return df.agg(norm.alias("norm"), F.least(F.lit(1.0), most / (norm + 1e-6)).alias("coefficient"))
