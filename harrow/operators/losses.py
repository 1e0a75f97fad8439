"""Policy, value and preference losses as expressions over one row per token, and their aggregation.

Token rows have logp, old_logp, advantage, mask (1 or 0) and the sequence they are of. Every loss adds
columns; :func:`aggregate_loss` sums them up in one of four ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.operators.draws import multinomial
from harrow.operators.select import ranked


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kl_estimate(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """k1, abs, k2 or k3 (clamped); a trailing "+" changes gradients only, so the value is the same."""
    d = logp - ref
    match kind.rstrip("+"):
        case "k1" | "kl":
            return d
        case "abs":
            return F.abs(d)
        case "k2" | "mse":
            return 0.5 * d * d
        case "k3" | "low_var_kl":
            back = clamp(-d, -20.0, 20.0)
            return clamp(F.exp(back) - back - 1, -10.0, 10.0)
    raise ValueError(f"no estimate named {kind!r}")


def ppo(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> dict[str, Column]:
    """Clipped loss with a dual clip for negative advantages, and the two clip flags and the KL of each token."""
    ratio = F.exp(clamp(logp - old, -20.0, 20.0))
    plain, clipped, bound = -adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high), -adv * dual
    worst = F.greatest(plain, clipped)
    return {
        "loss": F.when(adv < 0, F.least(bound, worst)).otherwise(worst),
        "clipped": (clipped > plain).cast("double"),
        "clipped_lower": ((worst > bound) & (adv < 0)).cast("double"),
        "kl": -clamp(logp - old, -20.0, 20.0),
    }


def gspo(df: DataFrame, seq: str = "group_id", low: float = 0.2, high: float = 0.2) -> DataFrame:
    """The ratio is the sequence's, a mean over its unmasked tokens."""
    w = W.partitionBy(seq)
    mean = F.sum((F.col("logp") - F.col("old_logp")) * F.col("mask")).over(w) / F.greatest(F.sum("mask").over(w), F.lit(1))
    ratio, adv = F.exp(F.least(mean, F.lit(10.0))), F.col("advantage")
    return df.withColumn("ratio", ratio).withColumn("loss", F.greatest(-adv * F.col("ratio"), -adv * clamp(F.col("ratio"), 1 - low, 1 + high)))


def geometric(df: DataFrame, seq: str = "group_id", low: float = 0.4, high: float = 0.4, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per sequence: the geometric mean of its ratios, each clamped in log space on the side that
    the sign of the advantage asks for (1 where the advantage is 0), times the mean advantage; and ``more`` aggregates."""
    step = clamp(F.col("logp") - F.col("old_logp"), -20.0, 20.0)
    sign = F.signum(F.col("advantage"))
    held = sign * F.least(sign * step, sign * clamp(step, -low, high))
    n = F.sum("mask")
    return df.withColumn("held", held).groupBy(seq).agg((F.exp(F.sum(F.col("held") * F.col("mask")) / (n + 1e-8)) * -(F.sum(F.col("advantage") * F.col("mask")) / (n + 1e-8))).alias("loss"), *(c.alias(k) for k, c in (more or {}).items()))


def covariance(df: DataFrame) -> DataFrame:
    """Adds each token's part in the covariance of advantage and log-probability over unmasked tokens."""
    m = F.col("mask")
    means = df.agg(*((F.sum(F.col(c) * m) / (F.sum(m) + 1e-8)).alias(f"__{c}") for c in ("advantage", "logp")))
    out = df.crossJoin(F.broadcast(means))
    return out.withColumn("cov", (F.col("advantage") - F.col("__advantage")) * (F.col("logp") - F.col("__logp"))).drop("__advantage", "__logp")


def kl_cov(df: DataFrame, order: list[str], share: float = 0.002, beta: float = 1.0) -> DataFrame:
    """The ``share`` of unmasked tokens with the largest covariance pays a KL term; ties by ``order``.
    Only tokens from a bound on are ranked, by a range partitioning: a quantile, below which lie no tokens of the share; all are where
    that doesn't hold. The last token of the share is one row, which all are compared with."""
    cov = covariance(df)
    on = (F.col("mask") == 1) & F.col("cov").isNotNull()
    own = cov.where(on).select("cov", *order)
    k = F.greatest(F.floor(F.lit(share) * F.count_if(F.col("mask") == 1)), F.lit(1))
    cut = cov.agg(k.alias("k"), F.percentile_approx(F.when(on, F.col("cov")), F.lit(max(0.0, 1 - share - 0.002)), F.lit(2000)).alias("bound"))
    held = own.crossJoin(F.broadcast(cut)).agg(F.max("k").alias("k"), F.when(F.count_if(F.col("cov") >= F.col("bound")) >= F.max("k"), F.max("bound")).alias("bound"))
    ranks = ranked(own.crossJoin(F.broadcast(held)).where("bound is null or cov >= bound").drop("bound"), [F.desc("cov"), *order])
    last = ranks.where("rank <= k").agg(F.max_by(F.struct("cov", F.struct(*order).alias("at")), "rank").alias("__last"))
    at, key = F.col("__last.cov"), F.struct(*order)
    picked = on & ((F.col("cov") > at) | ((F.col("cov") == at) & (key <= F.col("__last.at"))))
    d = F.col("old_logp") - F.col("logp")
    base = -F.col("advantage") * F.exp(F.col("logp") - F.col("old_logp"))
    return cov.crossJoin(F.broadcast(last)).withColumn("loss", F.when(picked, base + beta * F.abs(d)).otherwise(base)).drop("__last")


def value_loss(value: Column, old: Column, target: Column, clip: float = 0.5) -> Column:
    held = F.least(F.greatest(value, old - clip), old + clip)
    return 0.5 * F.greatest((value - target) * (value - target), (held - target) * (held - target))


def aggregate_loss(df: DataFrame, mode: str = "token-mean", seq: str = "group_id", loss: str = "loss", norm: int | None = None) -> DataFrame:
    """One number: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm."""
    return aggregate_with(df, {}, mode, seq, loss, norm)


def aggregate_with(df: DataFrame, means: dict[str, Column], mode: str = "token-mean", seq: str = "group_id", loss: str = "loss", norm: int | None = None) -> DataFrame:
    """One row of the loss by ``mode``, and of masked means over all tokens, in one pass; only a mode that needs sequences deals by them."""
    total, n = F.sum(F.col(loss) * F.col("mask")), F.sum("mask")
    if mode == "token-mean":
        return df.agg((total / (n + 1e-8)).alias("loss"), *((F.sum(x * F.col("mask")) / (n + 1e-8)).alias(c) for c, x in means.items()))
    sums = {c: F.sum(x * F.col("mask")).alias(f"__{c}") for c, x in means.items()}
    part = df.groupBy(seq).agg(total.alias("s"), n.alias("n"), F.count("*").alias("len"), *sums.values())
    of_mode = {
        "seq-mean-token-sum": F.avg("s"),
        "seq-mean-token-mean": F.avg(F.col("s") / (F.col("n") + 1e-8)),
        "seq-mean-token-sum-norm": F.sum("s") / (F.lit(norm) if norm else F.max("len")),
    }
    if mode not in of_mode:
        raise ValueError(f"no aggregation named {mode!r}")
    return part.agg(of_mode[mode].alias("loss"), *((F.sum(f"__{c}") / (F.sum("n") + 1e-8)).alias(c) for c in means))


def importance_weights(df: DataFrame, level: str = "token", mode: str = "truncate", high: float = 2.0, low: float = 0.5, veto: float | None = 1e-4, seq: str = "group_id") -> DataFrame:
    """Adds ``weight``: the rollout's importance ratio by token, sequence or geometric mean. "truncate" caps
    it, "mask" sets it to 0 outside the band; a token ratio under ``veto`` silences its sequence."""
    w = W.partitionBy(seq)
    d, m = F.col("logp") - F.col("old_logp"), F.col("mask")
    total, n = F.sum(d * m).over(w), F.sum(m).over(w)
    raw = {"token": d, "sequence": total, "geometric": total / (n + 1e-8)}[level]
    ratio = F.exp(clamp(raw, -20.0, 20.0))
    weight = F.least(ratio, F.lit(high)) if mode == "truncate" else F.when(ratio.between(low, high), ratio).otherwise(0.0)
    if veto is not None:
        weight = F.when(F.min(F.when(m == 1, F.exp(clamp(d, -20.0, 20.0)))).over(w) < veto, 0.0).otherwise(weight)
    return df.withColumn("ratio", ratio).withColumn("weight", weight * m)


def importance_metrics(df: DataFrame) -> DataFrame:
    """Mean, extremes, shares outside (0.5, 2), effective sample size, and two KL estimates, over unmasked tokens."""
    r, on = F.col("ratio"), df.where("mask = 1")
    d = F.col("logp") - F.col("old_logp")
    mean = F.avg(r)
    return on.agg(mean.alias("ratio_mean"), F.min(r).alias("ratio_min"), F.max(r).alias("ratio_max"), F.avg((r > 2).cast("double")).alias("share_high"), F.avg((r < 0.5).cast("double")).alias("share_low"), (F.sum(r) * F.sum(r) / (F.sum(r * r) * F.count("*"))).alias("ess"), F.avg(-d).alias("kl_k1"), F.avg(F.exp(d) - d - 1).alias("kl_k3"))


def dpo(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, kind: str = "sigmoid", smoothing: float = 0.0) -> Column:
    h = (chosen - rejected) - (ref_chosen - ref_rejected)
    if kind == "ipo":
        return (h - 1 / (2 * beta)) * (h - 1 / (2 * beta))
    return (1 - smoothing) * F.log1p(F.exp(-beta * h)) + smoothing * F.log1p(F.exp(beta * h))


def sppo(logp: Column, ref: Column, reward: Column, beta: float = 1.0, eta: float = 1000.0) -> Column:
    """Squared distance of the log-ratio from the scaled reward's distance from one half."""
    d = logp - ref - eta * (reward - 0.5) / beta
    return d * d


def preference_pairs(df: DataFrame, group: str = "group_id", order: str = "sample_id", reward: str = "reward") -> DataFrame:
    """Neighbours (0, 1), (2, 3), ... of a group, the better one chosen, the first on a tie; an odd last row has none."""
    pair = F.floor(F.col(order) / 2)
    got = df.groupBy(group, pair.alias("pair")).agg(F.count("*").alias("n"), F.max_by(F.struct(*df.columns), F.struct(F.col(reward), -F.col(order))).alias("chosen"), F.min_by(F.struct(*df.columns), F.struct(F.col(reward), -F.col(order))).alias("rejected"))
    return got.where("n = 2").drop("n")


def resample(df: DataFrame, key: list[str], reward: str = "reward", mode: str = "pow", power: float = 2.0, seed: int = 0) -> DataFrame:
    """As many independent draws as rows, with replacement, by weight; adds copies. Weights are |reward|^power; or 1 for the
    largest and the least reward and else 0 (max_min); or 0.4 for the largest and else 0.1 (max_random); plus 1e-8."""
    r = F.col(reward)
    if mode == "pow":
        return multinomial(df, key, F.pow(F.abs(r), F.lit(power)) + 1e-8, seed=seed)
    if mode not in ("max_min", "max_random"):
        raise ValueError(f"no weights named {mode!r}")
    ends = df.agg(F.max(r).alias("__hi"), F.min(r).alias("__lo"))
    hi, lo = r == F.col("__hi"), r == F.col("__lo")
    weight = F.when(hi | lo, 1.0).otherwise(0.0) if mode == "max_min" else F.when(hi, 0.4).otherwise(0.1)
    return multinomial(df.crossJoin(F.broadcast(ends)), key, weight + 1e-8, seed=seed).drop("__hi", "__lo")


def clip_cov(df: DataFrame, order: list[str], share: float = 0.0002, low: float = 1.0, high: float = 5.0, clip: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds loss: the clipped loss, 0 for a hashed choice of ``share`` of the unmasked tokens among those whose
    covariance lies in (low, high) and that weren't clipped anyway. The choice is a hash bound at the share of
    candidates, so that nothing is sorted as a whole."""
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    a, b = -F.col("advantage") * ratio, -F.col("advantage") * clamp(ratio, 1 - clip, 1 + clip)
    rows = covariance(df).withColumn("__in", (F.col("mask") == 1) & ~(b > a) & (F.col("cov") > low) & (F.col("cov") < high))
    want = F.greatest(F.floor(share * F.count_if(F.col("mask") == 1)), F.lit(1))
    n = rows.agg(want.alias("__k"), F.count_if("__in").alias("__n"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(1 << 30)) / float(1 << 30)
    out = rows.crossJoin(F.broadcast(n)).withColumn("dropped", F.col("__in") & (drawn * F.col("__n") < F.col("__k")))
    return out.withColumn("loss", F.when(F.col("dropped"), 0.0).otherwise(F.greatest(a, b))).drop("__in", "__k", "__n")


def analysis_loss(df: DataFrame, seq: str = "group_id", over: str = "tokens") -> DataFrame:
    """One number of -ratio * advantage: "tokens" averages all unmasked tokens, "sequences" sums the sequences' means."""
    x = -F.exp(F.col("logp") - F.col("old_logp")) * F.col("advantage") * F.col("mask")
    part = df.groupBy(seq).agg(F.sum(x).alias("s"), F.sum("mask").alias("n"))
    return part.agg((F.sum("s") / F.sum("n")).alias("loss") if over == "tokens" else F.sum(F.try_divide("s", "n")).alias("loss"))


def reward_model_ce(score: Column, label: Column) -> Column:
    """Cross entropy of a sequence score against pass or fail."""
    return F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - label * score


def preference_accuracy(pairs: DataFrame, score_i: str, score_j: str, truth_i: str, truth_j: str, by: list[str]) -> DataFrame:
    """Share of pairs that the scores order as the truths do, weighted by the truths' gap; one half without any."""
    gap = F.col(truth_i) - F.col(truth_j)
    right = (F.col(score_i) - F.col(score_j)) * gap > 0
    w = F.abs(gap)
    return pairs.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.when(right, w).otherwise(0.0)), F.sum(w)), F.lit(0.5)).alias("accuracy"))


def entropy(logits: Column) -> Column:
    """Of the distribution that an array of logits gives, with the largest taken off first."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.log(z) + top - F.aggregate(F.zip_with(e, logits, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x) / z


def learning_rate(step: Column, kind: str, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> Column:
    """Factor of the base rate: linear warm-up, then constant, cosine, or stable with a linear decay."""
    up = step / float(max(1, warmup))
    done = (step - warmup) / float(max(1, total - warmup))
    if kind == "constant":
        after = F.lit(1.0)
    elif kind == "cosine":
        after = F.greatest(F.lit(0.0), least + (1 - least) * 0.5 * (1 + F.cos(F.pi() * 2 * cycles * done)))
    elif kind == "wsd":
        after = F.when(done < stable, 1.0).otherwise(F.greatest(F.lit(least), 1 - (1 - least) * (done - stable) / (1 - stable)))
    else:
        raise ValueError(f"no schedule named {kind!r}")
    return F.when(step < warmup, up).otherwise(after)


def sequence_weights(df: DataFrame, seq: str, low: float, high: float, weight: str = "weight") -> DataFrame:
    """Over the sequences' mean weights of unmasked tokens: mean, deviation, extremes, the largest distance from 1
    and the shares outside the bounds; sequences without such a token don't count."""
    each = df.where("mask = 1").groupBy(seq).agg(F.avg(weight).alias("w"))
    w = F.col("w")
    return each.agg(F.avg(w).alias("seq_mean"), F.coalesce(F.stddev_samp(w), F.lit(0.0)).alias("seq_std"), F.max(w).alias("seq_max"), F.min(w).alias("seq_min"), F.max(F.abs(w - 1)).alias("seq_max_deviation"), F.avg((w > high).cast("double")).alias("seq_share_high"), F.avg((w < low).cast("double")).alias("seq_share_low"))


def perplexities(df: DataFrame, seq: str, train: str, rollout: str) -> DataFrame:
    """Means over sequences of both policies' perplexity and its logarithm, of their difference and ratio."""
    each = df.where("mask = 1").groupBy(seq).agg((-F.avg(train)).alias("t"), (-F.avg(rollout)).alias("r"))
    d = F.col("t") - F.col("r")
    return each.agg(F.avg(F.exp("t")).alias("train_ppl"), F.avg("t").alias("train_log_ppl"), F.avg(F.exp("r")).alias("rollout_ppl"), F.avg("r").alias("rollout_log_ppl"), F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"), F.max(d).alias("log_ppl_diff_max"), F.min(d).alias("log_ppl_diff_min"), F.avg(F.exp(d)).alias("ppl_ratio"))


def detached_dpo(df: DataFrame, q: str, passed: str, group: str, beta: float = 0.05, best_of: str | None = None) -> DataFrame:
    """Adds loss: -log sigmoid of a response's scaled score less the mean score of its group's other class (0
    without one), with the sign of its own class. ``best_of`` names a column by whose rank in the group the loss
    is weighted: n times the share of values at most this one, to the power n - 1."""
    whole, own = W.partitionBy(group), F.coalesce(F.col(passed), F.lit(False))
    other = F.when(own, F.avg(F.when(~own, F.col(q))).over(whole)).otherwise(F.avg(F.when(own, F.col(q))).over(whole))
    h = beta * (F.col(q) - F.coalesce(other, F.lit(0.0))) * F.when(own, 1.0).otherwise(-1.0)
    # log(1 + exp(-h)) without overflow
    loss = F.log1p(F.exp(-F.abs(h))) + F.greatest(-h, F.lit(0.0))
    if best_of is not None:
        n = F.count("*").over(whole)
        upto = F.count("*").over(whole.orderBy(best_of))
        loss = loss * n * F.pow(upto / n, (n - 1).cast("double"))
    return df.withColumn("loss", loss)


def absolute_accuracy(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Share of responses whose score has the sign of 2 * truth - 1."""
    return df.groupBy(*by).agg(F.avg((F.signum(score) == F.signum(F.col(truth) * 2 - 1)).cast("double")).alias("accuracy"))
