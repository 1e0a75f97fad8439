"""Policy losses by name: each of one row per token (logp, old_logp, advantage, mask, and the sequence), as one row of a batch's
loss, share of clipped tokens, KL, and share clipped on the lower side.

A token-level policy gives columns that are averaged together in one aggregation by sequence; what a whole sequence needs, or all
tokens, is computed before by the operators in :mod:`harrow.operators.losses`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators import losses as L


@dataclass(frozen=True)
class Batch:
    """Token rows, the columns that order them totally, the sequence's column, and the column of weights of each token, if any."""

    rows: DataFrame
    order: tuple[str, ...] = ("group_id", "sample_id")
    seq: str = "group_id"
    weight: str | None = None

    @property
    def step(self) -> Column:
        return F.col("logp") - F.col("old_logp")

    @property
    def weights(self) -> Column:
        return F.lit(1.0) if self.weight is None else F.col(self.weight)


Policy = Callable[..., DataFrame]
POLICIES: dict[str, Policy] = {}
PARTS = ("loss", "clipped", "kl", "clipped_lower")


def policy(name: str) -> Callable[[Policy], Policy]:
    """Registers a policy; one of the same name is replaced, as a user's own may stand in for a given one."""

    def add(fn: Policy) -> Policy:
        POLICIES[name] = fn
        return fn

    return add


def policy_loss(name: str, batch: Batch, mode: str = "token-mean", **options: float) -> DataFrame:
    """One row (loss, clipped, kl, clipped_lower). ``mode`` is how tokens' losses become one; two policies have their own."""
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; there are {', '.join(sorted(POLICIES))}")
    return POLICIES[name](batch, mode, **options).select(*(F.col(c).cast("double").alias(c) for c in PARTS))


def _together(batch: Batch, rows: DataFrame, mode: str, clipped: Column, kl: Column, lower: Column) -> DataFrame:
    """The loss by mode and the masked means of the others, in one pass over the tokens."""
    weighed = rows.withColumn("loss", F.col("loss") * batch.weights)
    return L.aggregate_with(weighed, {"clipped": clipped, "kl": kl, "clipped_lower": lower}, mode, batch.seq)


@policy("vanilla")
def vanilla(batch: Batch, mode: str, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    rows = batch.rows.withColumns({k if k == "loss" else f"__{k}": v for k, v in L.ppo(F.col("logp"), F.col("old_logp"), F.col("advantage"), low, high, dual).items()})
    return _together(batch, rows, mode, F.col("__clipped"), F.col("__kl"), F.col("__clipped_lower"))


@policy("gspo")
def gspo(batch: Batch, mode: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Tokens' losses are averaged by sequence, then over sequences, whatever ``mode`` says; there is no lower clip."""
    rows, adv, ratio = L.gspo(batch.rows, batch.seq, low, high), F.col("advantage"), F.col("ratio")
    clipped = (-adv * L.clamp(ratio, 1 - low, 1 + high) > -adv * ratio).cast("double")
    return _together(batch, rows, "seq-mean-token-mean", clipped, -batch.step, F.lit(0.0))


@policy("gpg")
def gpg(batch: Batch, mode: str) -> DataFrame:
    """The plain gradient's loss, without a ratio, so nothing is clipped and no KL is measured."""
    return _together(batch, batch.rows.withColumn("loss", -F.col("logp") * F.col("advantage")), mode, F.lit(0.0), F.lit(0.0), F.lit(0.0))


@policy("clip_cov")
def clip_cov(batch: Batch, mode: str, share: float = 0.0002, low: float = 1.0, high: float = 5.0, clip: float = 0.2, seed: int = 0) -> DataFrame:
    rows = L.clip_cov(batch.rows, list(batch.order), share, low, high, clip, seed)
    return _together(batch, rows, mode, F.col("dropped").cast("double"), -batch.step, F.lit(0.0))


@policy("kl_cov")
def kl_cov(batch: Batch, mode: str, share: float = 0.0002, beta: float = 1.0) -> DataFrame:
    """The KL is that of absolute differences."""
    rows = L.kl_cov(batch.rows, list(batch.order), share, beta)
    return _together(batch, rows, mode, F.lit(0.0), F.abs(batch.step), F.lit(0.0))


@policy("geo_mean")
def geo_mean(batch: Batch, mode: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """A mean over sequences, whatever ``mode`` says; a sequence's weight is its tokens' geometric mean. Clipped are the steps out
    of bounds of tokens with an advantage, lower those with a negative one."""
    mask, step, adv = F.col("mask"), batch.step, F.col("advantage")
    out = ((step < -low) | (step > high)).cast("double")
    parts = {"clipped": out * (adv > 0).cast("double"), "kl": -step, "clipped_lower": out * (adv < 0).cast("double")}
    log = F.sum(F.log(batch.weights + 1e-10) * mask) / (F.sum("mask") + 1e-8)
    sums = {f"__{c}": F.sum(x * mask) for c, x in parts.items()} | {"__n": F.sum("mask"), "__w": F.lit(1.0) if batch.weight is None else F.exp(log)}
    losses = L.geometric(batch.rows, batch.seq, low, high, sums)
    return losses.agg(F.avg(F.col("loss") * F.col("__w")).alias("loss"), *((F.sum(f"__{c}") / (F.sum("__n") + 1e-8)).alias(c) for c in parts))
