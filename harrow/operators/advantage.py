"""Advantages from group rewards.

Rows are responses (group, reward, ...). A group's statistics are windows over its partition; no group
is collected. Estimators are found by name in ``ESTIMATORS``. Singleton groups differ between them:
"reward" keeps the reward, "zero" gives 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from harrow.operators.scan import CHUNK, affine_scan, compose, longest

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(fn: Callable) -> Callable:
        if name in ESTIMATORS and ESTIMATORS[name] is not fn:
            raise ValueError(f"an estimator named {name!r} exists already")
        ESTIMATORS[name] = fn
        return fn

    return add


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise KeyError(f"no estimator named {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def group_stats(reward: str = "reward", group: str = "group_id") -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation of a row's group; the deviation of a singleton is null."""
    w = W.partitionBy(group)
    return F.count("*").over(w), F.avg(reward).over(w), F.stddev_samp(reward).over(w)


@register("grpo")
def grpo(df: DataFrame, group: str = "group_id", reward: str = "reward", by_std: bool = True, singleton: str = "reward", floor: float = 0.0, eps: float = EPS) -> DataFrame:
    """(r - mean) / (std + eps); ``floor`` is the least variance. Adds ``advantage``."""
    n, mean, std = group_stats(reward, group)
    if floor:
        std = F.greatest(std, F.lit(floor**0.5))
    centred = F.when(n > 1, F.col(reward) - mean).otherwise(F.col(reward) if singleton == "reward" else F.lit(0.0))
    scale = F.when(n > 1, std).otherwise(F.lit(1.0)) + eps if by_std else F.lit(1.0)
    return df.withColumn("advantage", centred / scale)


@register("grpo_floor")
def grpo_floor(df: DataFrame, **how) -> DataFrame:
    return grpo(df, floor=EPS, **how)


@register("grpo_selection")
def grpo_selection(df: DataFrame, by_std: bool = False, **how) -> DataFrame:
    """The variant that ranks candidates: centred only, nothing for singletons."""
    return grpo(df, by_std=by_std, singleton="zero", **how)


@register("grpo_spectral")
def grpo_spectral(df: DataFrame, group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Adds advantage, mean, std and whether all of the group's advantages vanish."""
    n, mean, std = group_stats(reward, group)
    out = grpo(df, group, reward).withColumns({"mean": F.when(n > 1, mean).otherwise(0.0), "std": F.when(n > 1, std).otherwise(1.0)})
    return out.withColumn("zero_advantage", F.bool_and(F.abs("advantage") < EPS).over(W.partitionBy(group)))


@register("pass_k")
def pass_k(df: DataFrame, group: str = "group_id", reward: str = "reward", sample: str = "sample_id", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """The best response gets its lead over the second best, the others 0; a tie has no lead. Groups of
    one have none either: ``strict_groups`` tells whether there are any."""
    n, _, std = group_stats(reward, group)
    order = W.partitionBy(group).orderBy(F.desc(reward), sample)
    lead = F.col(reward) - F.lead(reward).over(order)
    best = F.row_number().over(order) == 1
    return df.withColumn("advantage", F.when(best & (n > 1), lead / ((std if by_std else F.lit(1.0)) + (eps if by_std else 0.0))).otherwise(0.0))


def strict_groups(df: DataFrame, group: str = "group_id", least: int = 2) -> DataFrame:
    """Groups with fewer rows than an estimator needs."""
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)


@register("rloo")
def rloo(df: DataFrame, group: str = "group_id", reward: str = "reward", singleton: str = "reward") -> DataFrame:
    """Each reward against the mean of the others."""
    n, mean, _ = group_stats(reward, group)
    return df.withColumn("advantage", F.when(n > 1, (F.col(reward) - mean) * n / F.greatest(n - 1, F.lit(1))).otherwise(F.col(reward) if singleton == "reward" else F.lit(0.0)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, **how) -> DataFrame:
    return rloo(df, singleton="zero", **how)


@register("opo")
def opo(df: DataFrame, group: str = "group_id", reward: str = "reward", length: str = "length") -> DataFrame:
    """Against the length-weighted mean."""
    w = W.partitionBy(group)
    base = F.sum(F.col(length) * F.col(reward)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(reward) - F.when(F.count("*").over(w) > 1, base).otherwise(0.0))


@register("gpg")
def gpg(df: DataFrame, group: str = "group_id", reward: str = "reward", f_norm: float = 1.0) -> DataFrame:
    """Centred and scaled by the batch's share of rewards that are not 0, one number that joins all rows."""
    n, mean, _ = group_stats(reward, group)
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(reward) != 0), F.lit(1))).alias("alpha"))
    out = df.withColumn("centred", F.col(reward) - F.when(n > 1, mean).otherwise(0.0)).crossJoin(F.broadcast(alpha))
    return out.withColumn("advantage", F.col("alpha") * F.col("centred") / f_norm).drop("alpha", "centred")


def whiten(df: DataFrame, value: str, weight: Column, shift_mean: bool = True) -> DataFrame:
    """``value`` whitened over all rows, each counted ``weight`` times (its unmasked tokens). Mean with
    1e-8 in its divisor, variance by Bessel over the weights, 1e-8 under the root."""
    x, w = F.col(value), weight
    means = df.agg((F.sum(x * w) / (F.sum(w) + 1e-8)).alias("__m"))
    own = df.crossJoin(F.broadcast(means))
    mean, n = F.col("__m"), F.col("__n")
    # deviations are squared, not values: no digits cancel where the mean is large
    spread = own.agg(F.sum(w).alias("__n"), (F.sum((x - mean) * (x - mean) * w) / (F.sum(w) + 1e-8)).alias("__v"))
    variance = F.col("__v")
    bessel = F.when(n > 1, variance * n / (n - 1)).otherwise(variance)
    scaled = (x - mean) / F.sqrt(bessel + 1e-8)
    return own.crossJoin(F.broadcast(spread)).withColumn(value, scaled if shift_mean else scaled + mean).drop("__m", "__n", "__v")


@register("reinforce_baseline")
def reinforce_baseline(df: DataFrame, group: str = "group_id", reward: str = "reward", length: str = "length") -> DataFrame:
    """Centred by the group, whitened over the batch's tokens; a response's tokens share its value."""
    n, mean, _ = group_stats(reward, group)
    return whiten(df.withColumn("advantage", F.col(reward) - F.when(n > 1, mean).otherwise(0.0)), "advantage", F.col(length))


def soft_mean(df: DataFrame, reward: str = "reward", beta: float = 1.0) -> DataFrame:
    """Adds the batch's log-mean-exp baseline and the reward over it; beta 0 is the mean."""
    if beta == 0:
        base = df.agg(F.avg(reward).alias("baseline"))
    else:
        top = df.agg(F.max(F.col(reward) * beta).alias("top"))
        base = df.crossJoin(F.broadcast(top)).agg(((F.log(F.avg(F.exp(F.col(reward) * beta - F.col("top")))) + F.max("top")) / beta).alias("baseline"))
    return df.crossJoin(F.broadcast(base)).withColumn("advantage", F.col(reward) - F.col("baseline"))


# ---- token sequences: one row per response, arrays per token ------------------------------------


@F.pandas_udf(ArrayType(DoubleType()))
def _scan(a: pd.Series, b: pd.Series) -> pd.Series:
    """x_i = a_i x_(i+1) + b_i of each sequence, 0 after its last token; a batch of sequences at once."""
    sizes = [0 if x is None else len(x) for x in a]
    begins = np.append(0, np.cumsum(sizes))
    flat = lambda s: np.concatenate([np.zeros(0), *(np.asarray(x, float) for x in s if x is not None)])
    _, x = compose(flat(a), flat(b), np.unique(begins[:-1])) if begins[-1] else (None, np.zeros(0))
    return pd.Series([None if s is None else x[i:j] for s, i, j in zip(a, begins[:-1].tolist(), begins[1:].tolist(), strict=True)])


def _after(x: Column) -> Column:
    """The array moved by one: each token sees the next one's value, the last one 0."""
    return F.when(F.size(x) > 0, F.array_append(F.slice(x, 2, F.size(x)), F.lit(0.0))).otherwise(x)


def gae(df: DataFrame, gamma: float = 0.9, lam: float = 0.95, reward: str = "reward", value: str = "value", mask: str = "mask") -> DataFrame:
    """Adds advantages and returns per token, before whitening; masked tokens are passed over."""
    on = F.transform(mask, lambda m: (m == 1).cast("double"))
    later = _after(_scan(F.transform(on, lambda m: 1 - m), F.zip_with(on, value, lambda m, v: m * v)))
    gain = F.zip_with(F.zip_with(reward, value, lambda r, v: r - v), later, lambda d, n: d + gamma * n)
    got = _scan(F.transform(on, lambda m: 1 - m + gamma * lam * m), F.zip_with(on, gain, lambda m, g: m * g))
    return df.withColumn("advantages", got).withColumn("returns", F.zip_with("advantages", value, lambda a, v: a + v))


def reinforce_returns(df: DataFrame, gamma: float = 0.9, reward: str = "reward", mask: str = "mask") -> DataFrame:
    """Discounted returns from each token on, started anew after a masked one."""
    return df.withColumn("returns", _scan(_after(F.transform(mask, lambda m: gamma * m)), F.transform(reward, lambda r: r.cast("double"))))


def remax(df: DataFrame, baseline: Column, reward: str = "reward", mask: str = "mask") -> DataFrame:
    """Sums of the unmasked rewards from each token on, less a baseline on unmasked tokens."""
    out = df.withColumn("returns", _scan(F.transform(mask, lambda m: F.lit(1.0)), F.zip_with(reward, mask, lambda r, m: r * m)))
    return out.withColumn("advantages", F.zip_with("returns", mask, lambda r, m: r - baseline * m))


# ---- the same over sequences that no row can hold: one row per token ------------------------------


def gae_rows(df: DataFrame, gamma: float = 0.9, lam: float = 0.95, seq: str = "group_id", pos: str = "sample_id", reward: str = "reward", value: str = "value", mask: str = "mask", chunk: int = CHUNK) -> DataFrame:
    """Adds advantage and return to rows of one token each (:mod:`scan`)."""
    on, last = F.col(mask) == 1, longest(df, pos)
    later = affine_scan(df, seq, pos, F.when(on, 0.0).otherwise(1.0), F.when(on, F.col(value)).otherwise(0.0), after="__next", last=last, chunk=chunk)
    gain = F.col(reward) + gamma * F.col("__next") - F.col(value)
    out = affine_scan(later, seq, pos, F.when(on, gamma * lam).otherwise(1.0), F.when(on, gain).otherwise(0.0), "advantage", last=last, chunk=chunk)
    return out.withColumn("return", F.col("advantage") + F.col(value)).drop("__next")


def reinforce_rows(df: DataFrame, gamma: float = 0.9, seq: str = "group_id", pos: str = "sample_id", reward: str = "reward", mask: str = "mask", chunk: int = CHUNK) -> DataFrame:
    """Adds return to rows of one token each: a token's return is its reward and, discounted, what the next token passes
    back, which is its return if it is unmasked."""
    m = F.col(mask).cast("double")
    passed = affine_scan(df, seq, pos, m * gamma, m * F.col(reward), after="__passed", chunk=chunk)
    return passed.withColumn("return", F.col(reward) + gamma * F.col("__passed")).drop("__passed")


def remax_rows(df: DataFrame, baseline: Column, seq: str = "group_id", pos: str = "sample_id", reward: str = "reward", mask: str = "mask", chunk: int = CHUNK) -> DataFrame:
    """Adds return and advantage to rows of one token each."""
    out = affine_scan(df, seq, pos, F.lit(1.0), F.col(reward) * F.col(mask), "return", chunk=chunk)
    return out.withColumn("advantage", F.col("return") - baseline * F.col(mask))


def prime_rewards(df: DataFrame, sources: dict[str, float], group: str = "group_id") -> DataFrame:
    """Leave-one-out values of several reward columns, summed by weight."""
    total = F.lit(0.0)
    for reward, weight in sources.items():
        n, mean, _ = group_stats(reward, group)
        total = total + weight * F.when(n > 1, (F.col(reward) - mean) * n / F.greatest(n - 1, F.lit(1))).otherwise(F.col(reward))
    return df.withColumn("advantage", total)


def kl_reward(df: DataFrame, score: str, logp: str, ref: str, beta: float) -> DataFrame:
    """Token scores less ``beta`` times the log-ratio; rows of one token."""
    return df.withColumn("kl", F.col(logp) - F.col(ref)).withColumn("token_reward", F.col(score) - beta * F.col("kl"))


def adaptive_coefficient(current: float, kl: float, target: float, horizon: int, steps: int) -> float:
    """The next KL coefficient; the relative error counts to 0.2."""
    return current * (1 + max(-0.2, min(0.2, kl / target - 1)) * steps / horizon)


def response_mask(tokens: Column, eos: int) -> Column:
    """1 up to and with the first end token."""
    at = F.array_position(tokens, eos)
    return F.transform(tokens, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def reverse_sums(df: DataFrame, value: str, group: str, order: str) -> DataFrame:
    """``value`` summed from each row of a sequence to its end."""
    return df.withColumn(value, F.sum(value).over(W.partitionBy(group).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)))


def whitened_returns(df: DataFrame, value: str, mask: Column) -> DataFrame:
    """Token values whitened over the unmasked tokens of the batch; 0 on masked ones."""
    return whiten(df, value, mask).withColumn(value, F.col(value) * mask)
