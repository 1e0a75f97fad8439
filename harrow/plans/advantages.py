"""Queries of the group advantages, returns and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import advantage as A
from harrow.operators import losses as L
from harrow.operators import policies as P
from harrow.plans import standins as S
from harrow.plans.registry import query, r6
from harrow.sources.tables import cut

ROLL = f"WITH {S.SQL['rollouts']}"
OUT = ("group_id", "sample_id")
STATS = "count(*) OVER g AS n, avg(reward) OVER g AS mean, stddev_samp(reward) OVER g AS std, sum(reward) OVER g AS total"


def _stat_sql(expr: str) -> str:
    return f"{ROLL}, s AS (SELECT *, {STATS} FROM rollouts WINDOW g AS (PARTITION BY group_id)) SELECT group_id, sample_id, round({expr}, 6) + 0.0 AS advantage FROM s"


def _advantage(name: str, expr: str, estimator: str, **how) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return A.estimator(estimator)(S.rollouts(spark, sf_dir), **how).select(*OUT, r6("advantage").alias("advantage"))

    run.__name__ = name
    query(_stat_sql(expr))(run)


_advantage("grpo_advantage", "CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - mean) / (std + 1e-6) END", "grpo")
_advantage("grpo_no_std", "CASE WHEN n = 1 THEN reward ELSE reward - mean END", "grpo", by_std=False)
_advantage("grpo_floor", "CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - mean) / (greatest(std, 0.001) + 1e-6) END", "grpo_floor")
_advantage("grpo_selection_variant", "CASE WHEN n = 1 THEN 0 ELSE reward - mean END", "grpo_selection")
_advantage("rloo", "CASE WHEN n = 1 THEN reward ELSE (reward - (total - reward) / (n - 1)) END", "rloo")
_advantage("rloo_vectorized", "CASE WHEN n = 1 THEN 0 ELSE (n * reward - total) / (n - 1) END", "rloo_vectorized")


@query(f"""{ROLL}, s AS (SELECT *, count(*) OVER g AS n, stddev_samp(reward) OVER g AS std,
  row_number() OVER o AS k, reward - lead(reward) OVER o AS ahead FROM rollouts
  WINDOW g AS (PARTITION BY group_id), o AS (PARTITION BY group_id ORDER BY reward DESC, sample_id))
  SELECT group_id, sample_id, round(CASE WHEN k = 1 AND n > 1 THEN ahead / (std + 1e-6) ELSE 0 END, 6) + 0.0 AS advantage FROM s""")
def passk_advantage(spark, sf_dir):
    return A.pass_k(S.rollouts(spark, sf_dir)).select(*OUT, r6("advantage").alias("advantage"))


@query(f"""{ROLL}, s AS (SELECT *, count(*) OVER g AS n, sum(length * reward) OVER g / sum(length) OVER g AS base FROM rollouts WINDOW g AS (PARTITION BY group_id))
  SELECT group_id, sample_id, round(reward - CASE WHEN n > 1 THEN base ELSE 0 END, 6) + 0.0 AS advantage FROM s""")
def opo(spark, sf_dir):
    return A.opo(S.rollouts(spark, sf_dir)).select(*OUT, r6("advantage").alias("advantage"))


@query(f"""{ROLL}, s AS (SELECT *, count(*) OVER g AS n, avg(reward) OVER g AS mean FROM rollouts WINDOW g AS (PARTITION BY group_id)),
  a AS (SELECT count(*) / greatest(count(*) FILTER (reward <> 0), 1) AS alpha FROM rollouts)
  SELECT group_id, sample_id, round(alpha * (reward - CASE WHEN n > 1 THEN mean ELSE 0 END), 6) + 0.0 AS advantage FROM s, a""")
def gpg(spark, sf_dir):
    return A.gpg(S.rollouts(spark, sf_dir)).select(*OUT, r6("advantage").alias("advantage"))


@query(f"""{ROLL}, s AS (SELECT *, reward - CASE WHEN count(*) OVER g > 1 THEN avg(reward) OVER g ELSE 0 END AS x FROM rollouts WINDOW g AS (PARTITION BY group_id)),
  m AS (SELECT sum(x * length) / (sum(length) + 1e-8) AS mean, sum(length) AS n FROM s),
  v AS (SELECT sum((x - mean) * (x - mean) * length) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM s, m)
  SELECT group_id, sample_id, round((x - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantage FROM s, m, v""")
def rf_baseline(spark, sf_dir):
    return A.reinforce_baseline(S.rollouts(spark, sf_dir)).select(*OUT, r6("advantage").alias("advantage"))


@query(f"""{ROLL}, s AS (SELECT *, count(*) OVER g AS n, avg(reward) OVER g AS m, stddev_samp(reward) OVER g AS d FROM rollouts WINDOW g AS (PARTITION BY group_id)),
  t AS (SELECT *, CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - m) / (d + 1e-6) END AS a FROM s)
  SELECT group_id, max(CASE WHEN n = 1 THEN 0.0 ELSE round(m, 6) END) AS mean, max(CASE WHEN n = 1 THEN 1.0 ELSE round(d, 6) END) AS std, bool_and(abs(a) < 1e-6) AS zero_advantage FROM t GROUP BY group_id""")
def spectral_group_stats(spark, sf_dir):
    got = A.grpo_spectral(S.rollouts(spark, sf_dir))
    return got.groupBy("group_id").agg(F.round(F.max("mean"), 6).alias("mean"), F.round(F.max("std"), 6).alias("std"), F.bool_and("zero_advantage").alias("zero_advantage"))


@query(f"""{ROLL}, b AS (SELECT ln(avg(exp(2 * reward))) / 2 AS base FROM rollouts)
  SELECT group_id, sample_id, round(reward - base, 6) + 0.0 AS advantage FROM rollouts, b""")
def softmean_baseline(spark, sf_dir):
    return A.soft_mean(S.rollouts(spark, sf_dir), beta=2.0).select(*OUT, r6("advantage").alias("advantage"))


@query(f"""{ROLL}, s AS (SELECT *, count(*) OVER g AS n, sum(reward) OVER g AS tr, sum(value) OVER g AS tv FROM rollouts WINDOW g AS (PARTITION BY group_id))
  SELECT group_id, sample_id, round(CASE WHEN n = 1 THEN reward + 0.5 * value ELSE (reward - (tr - reward) / (n - 1)) + 0.5 * (value - (tv - value) / (n - 1)) END, 9) + 0.0 AS advantage FROM s""")
def prime_reward_sources(spark, sf_dir):
    return A.prime_rewards(S.rollouts(spark, sf_dir), {"reward": 1.0, "value": 0.5}).select(*OUT, (F.round("advantage", 9) + F.lit(0.0)).alias("advantage"))


# ---- scans over token sequences; samples of an order as its tokens -------------------------------

_STEPS = f"""{ROLL}, t AS (SELECT group_id, sample_id, reward AS r, value AS v, CASE WHEN masked_in THEN 1 ELSE 0 END AS m,
  count(*) OVER (PARTITION BY group_id) - 1 - sample_id AS k FROM rollouts)"""


@query(_STEPS.replace("WITH ", "WITH RECURSIVE ") + """, scan AS (
  SELECT group_id, k, r - v AS d, CASE WHEN m = 1 THEN v ELSE 0.0::DOUBLE END AS nxt, CASE WHEN m = 1 THEN r - v ELSE 0.0::DOUBLE END AS run FROM t WHERE k = 0
  UNION ALL
  SELECT t.group_id, t.k, t.r + 0.9 * s.nxt - t.v, CASE WHEN t.m = 1 THEN t.v ELSE s.nxt END, CASE WHEN t.m = 1 THEN t.r + 0.9 * s.nxt - t.v + 0.9 * 0.95 * s.run ELSE s.run END
  FROM scan s JOIN t ON t.group_id = s.group_id AND t.k = s.k + 1)
  SELECT t.group_id, t.sample_id, round(s.run, 6) + 0.0 AS advantage, round(s.run + t.v, 6) + 0.0 AS return FROM scan s JOIN t USING (group_id, k)""")
def gae(spark, sf_dir):
    got = A.gae(S.sequences(spark, sf_dir))
    rows = got.select("group_id", F.posexplode(F.arrays_zip("advantages", "returns")).alias("sample_id", "x"))
    return rows.select("group_id", F.col("sample_id").cast("long").alias("sample_id"), r6("x.advantages").alias("advantage"), r6("x.returns").alias("return"))


@query(_STEPS.replace("WITH ", "WITH RECURSIVE ") + """, scan AS (
  SELECT group_id, k, r AS got, r * m AS run FROM t WHERE k = 0
  UNION ALL SELECT t.group_id, t.k, t.r + 0.9 * s.run, (t.r + 0.9 * s.run) * t.m FROM scan s JOIN t ON t.group_id = s.group_id AND t.k = s.k + 1)
  SELECT t.group_id, t.sample_id, round(s.got, 6) + 0.0 AS return FROM scan s JOIN t USING (group_id, k)""")
def reinforce_pp(spark, sf_dir):
    rows = A.reinforce_returns(S.sequences(spark, sf_dir)).select("group_id", F.posexplode("returns").alias("sample_id", "x"))
    return rows.select("group_id", F.col("sample_id").cast("long").alias("sample_id"), r6("x").alias("return"))


@query(_STEPS + """ SELECT group_id, sample_id, round(sum(r * m) OVER o, 6) + 0.0 AS return, round(sum(r * m) OVER o - 0.25 * m, 6) + 0.0 AS advantage
  FROM t WINDOW o AS (PARTITION BY group_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def remax_returns(spark, sf_dir):
    got = A.remax(S.sequences(spark, sf_dir), F.lit(0.25))
    rows = got.select("group_id", F.posexplode(F.arrays_zip("advantages", "returns")).alias("sample_id", "x"))
    return rows.select("group_id", F.col("sample_id").cast("long").alias("sample_id"), r6("x.returns").alias("return"), r6("x.advantages").alias("advantage"))


@query("""SELECT o_orderkey AS group_id, [CASE WHEN p = 0 OR i <= p THEN 1 ELSE 0 END FOR i IN range(1, len(t) + 1)]::VARCHAR AS mask
  FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS t,
        coalesce(list_position(list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate), 4), 0) AS p FROM lineitem GROUP BY 1)""")
def eos_response_mask(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.array_sort(F.collect_list(F.struct(*S.LINE))).alias("t"))
    mask = A.response_mask(F.col("t.l_linenumber"), 4)
    return rows.select("group_id", F.concat(F.lit("["), F.array_join(F.transform(mask, lambda x: x.cast("string")), ", "), F.lit("]")).alias("mask"))


# ---- losses: each line is a token of its order's sequence --------------------------------------


def tokens(spark, sf_dir: str) -> DataFrame:
    rows = S.rollouts(spark, sf_dir).withColumn("mask", F.col("masked_in").cast("int"))
    return A.grpo(rows, by_std=False).select("group_id", "sample_id", "reward", "logp", "old_logp", "value", "mask", "advantage")


TOK = f"""{ROLL}, tok AS (SELECT group_id, sample_id, reward, logp, old_logp, value, CASE WHEN masked_in THEN 1 ELSE 0 END AS mask,
  CASE WHEN count(*) OVER g = 1 THEN reward ELSE reward - avg(reward) OVER g END AS advantage FROM rollouts WINDOW g AS (PARTITION BY group_id))"""
_CLAMPED = "greatest(least(logp - old_logp, 20), -20)"
_PPO = f"""{TOK}, r AS (SELECT *, exp({_CLAMPED}) AS ratio FROM tok),
  l AS (SELECT *, -advantage * ratio AS a, -advantage * greatest(least(ratio, 1.2), 0.8) AS b, -advantage * 3 AS c FROM r),
  p AS (SELECT *, greatest(a, b) AS w, CASE WHEN advantage < 0 THEN least(c, greatest(a, b)) ELSE greatest(a, b) END AS loss FROM l)"""


@query(f"{TOK} SELECT group_id, sample_id, round(logp - old_logp, 6) + 0.0 AS k1, round(abs(logp - old_logp), 6) + 0.0 AS abs_kl, round(0.5 * (logp - old_logp) ** 2, 6) + 0.0 AS k2, round(greatest(least(exp(-{_CLAMPED}) + {_CLAMPED} - 1, 10), -10), 6) + 0.0 AS k3 FROM tok")
def kl_estimators(spark, sf_dir):
    kind = lambda k: r6(L.kl_estimate(F.col("logp"), F.col("old_logp"), k))
    return tokens(spark, sf_dir).select(*OUT, kind("k1").alias("k1"), kind("abs").alias("abs_kl"), kind("k2").alias("k2"), kind("k3+").alias("k3"))


@query(f"{TOK} SELECT group_id, sample_id, round(logp - old_logp, 6) + 0.0 AS kl, round(reward - 0.05 * (logp - old_logp), 6) + 0.0 AS token_reward FROM tok")
def kl_penalized_reward(spark, sf_dir):
    return A.kl_reward(tokens(spark, sf_dir), "reward", "logp", "old_logp", 0.05).select(*OUT, r6("kl").alias("kl"), r6("token_reward").alias("token_reward"))


@query(f"""{_PPO} SELECT round(sum(loss * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS loss, round(sum((b > a)::INT * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS clipped,
  round(sum((w > c AND advantage < 0)::INT * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS clipped_lower, round(sum(-{_CLAMPED} * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS kl FROM p""")
def ppo_clip(spark, sf_dir):
    parts = L.ppo(F.col("logp"), F.col("old_logp"), F.col("advantage"))
    rows = tokens(spark, sf_dir).withColumns(parts)
    return rows.agg(*(r6(F.sum(F.col(c) * F.col("mask")) / (F.sum("mask") + 1e-8)).alias(c) for c in parts))


@query(f"""{_PPO}, s AS (SELECT group_id, sum(loss * mask) AS s, sum(mask) AS n, count(*) AS len FROM p GROUP BY group_id)
  SELECT 'token-mean' AS mode, round(sum(s) / (sum(n) + 1e-8), 6) + 0.0 AS loss FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 6) + 0.0 FROM s
  UNION ALL SELECT 'seq-mean-token-mean', round(avg(s / (n + 1e-8)), 6) + 0.0 FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / max(len), 6) + 0.0 FROM s""")
def loss_aggregation(spark, sf_dir):
    rows = tokens(spark, sf_dir).withColumn("loss", L.ppo(F.col("logp"), F.col("old_logp"), F.col("advantage"))["loss"])
    modes = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")
    parts = [L.aggregate_loss(rows, m).select(F.lit(m).alias("mode"), r6("loss").alias("loss")) for m in modes]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""{TOK}, s AS (SELECT *, exp(least(sum((logp - old_logp) * mask) OVER g / greatest(sum(mask) OVER g, 1), 10)) AS ratio FROM tok WINDOW g AS (PARTITION BY group_id))
  SELECT group_id, sample_id, round(ratio, 6) + 0.0 AS ratio, round(greatest(-advantage * ratio, -advantage * greatest(least(ratio, 1.2), 0.8)), 6) + 0.0 AS loss FROM s""")
def gspo(spark, sf_dir):
    return L.gspo(tokens(spark, sf_dir)).select(*OUT, r6("ratio").alias("ratio"), r6("loss").alias("loss"))


@query(f"""{TOK}, s AS (SELECT *, sign(advantage) AS sg, {_CLAMPED} AS d FROM tok),
  h AS (SELECT *, sg * least(sg * d, sg * greatest(least(d, 0.4), -0.4)) AS held FROM s)
  SELECT group_id, round(exp(sum(held * mask) / (sum(mask) + 1e-8)) * -(sum(advantage * mask) / (sum(mask) + 1e-8)), 6) + 0.0 AS loss FROM h GROUP BY group_id""")
def geo_mean(spark, sf_dir):
    return L.geometric(tokens(spark, sf_dir)).select("group_id", r6("loss").alias("loss"))


@query(f"""{TOK}, m AS (SELECT sum(advantage * mask) / (sum(mask) + 1e-8) AS a, sum(logp * mask) / (sum(mask) + 1e-8) AS l, greatest(floor(0.002 * sum(mask)), 1) AS k FROM tok),
  c AS (SELECT tok.*, k, row_number() OVER (PARTITION BY mask ORDER BY (advantage - a) * (logp - l) DESC, group_id, sample_id) AS nth FROM tok, m)
  SELECT count(*) FILTER (mask = 1 AND nth <= k) AS picked, round(sum(mask * (-advantage * exp(logp - old_logp) + CASE WHEN mask = 1 AND nth <= k THEN abs(logp - old_logp) ELSE 0 END)) / (sum(mask) + 1e-8), 4) AS loss FROM c""")
def kl_cov(spark, sf_dir):
    base = -F.col("advantage") * F.exp(F.col("logp") - F.col("old_logp"))
    got = L.kl_cov(tokens(spark, sf_dir), ["group_id", "sample_id"])
    n = F.greatest(F.floor(0.002 * F.sum("mask")), F.lit(1))
    return got.agg(n.cast("long").alias("picked"), F.round(F.sum(F.col("mask") * F.col("loss")) / (F.sum("mask") + 1e-8), 4).alias("loss"))


@query(f"""{TOK} SELECT group_id, sample_id, round(0.5 * greatest((value - reward) ** 2, (least(greatest(value, 0.5 - 0.2), 0.5 + 0.2) - reward) ** 2), 6) + 0.0 AS loss FROM tok""")
def value_loss(spark, sf_dir):
    return tokens(spark, sf_dir).select(*OUT, r6(L.value_loss(F.col("value"), F.lit(0.5), F.col("reward"), 0.2)).alias("loss"))


@query(f"{TOK} SELECT group_id, sample_id, round((logp - old_logp - 10.0 * (reward - 0.5)) ** 2, 5) + 0.0 AS loss FROM tok")
def sppo(spark, sf_dir):
    return tokens(spark, sf_dir).select(*OUT, (F.round(L.sppo(F.col("logp"), F.col("old_logp"), F.col("reward"), eta=10.0), 5) + 0.0).alias("loss"))


@query(f"""{TOK}, d AS (SELECT *, logp - old_logp AS d FROM tok), s AS (SELECT *, sum(d * mask) OVER g AS total, sum(mask) OVER g AS n, min(CASE WHEN mask = 1 THEN exp(greatest(least(d, 20), -20)) END) OVER g AS low FROM d WINDOW g AS (PARTITION BY group_id)),
  w AS (SELECT *, exp(greatest(least(d, 20), -20)) AS tr, exp(greatest(least(total, 20), -20)) AS sr, exp(greatest(least(total / (n + 1e-8), 20), -20)) AS gr, coalesce(low < 1e-4, false) AS veto FROM s)
  SELECT group_id, sample_id, round(CASE WHEN veto THEN 0 ELSE least(tr, 2) END * mask, 6) + 0.0 AS token_truncate,
    round(CASE WHEN veto OR NOT sr BETWEEN 0.5 AND 2 THEN 0 ELSE sr END * mask, 6) + 0.0 AS sequence_mask, round(CASE WHEN veto THEN 0 ELSE least(gr, 2) END * mask, 6) + 0.0 AS geometric_truncate FROM w""")
def importance_weights(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    for level, mode in (("token", "truncate"), ("sequence", "mask"), ("geometric", "truncate")):
        rows = L.importance_weights(rows, level, mode).withColumnRenamed("weight", f"{level}_{mode}").drop("ratio")
    return rows.select(*OUT, *(r6(c).alias(c) for c in ("token_truncate", "sequence_mask", "geometric_truncate")))


@query(f"""{TOK}, r AS (SELECT exp(greatest(least(logp - old_logp, 20), -20)) AS r, logp - old_logp AS d FROM tok WHERE mask = 1)
  SELECT round(avg(r), 6) AS ratio_mean, round(min(r), 6) AS ratio_min, round(max(r), 6) AS ratio_max, round(avg((r > 2)::INT), 6) AS share_high, round(avg((r < 0.5)::INT), 6) AS share_low,
  round(sum(r) ** 2 / (sum(r * r) * count(*)), 6) AS ess, round(avg(-d), 6) + 0.0 AS kl_k1, round(avg(exp(d) - d - 1), 6) AS kl_k3 FROM r""")
def importance_metrics(spark, sf_dir):
    got = L.importance_metrics(L.importance_weights(tokens(spark, sf_dir), veto=None))
    return got.select(*(r6(c).alias(c) for c in got.columns))


@query(f"""{TOK}, p AS (SELECT *, row_number() OVER (PARTITION BY group_id, sample_id // 2 ORDER BY reward DESC, sample_id) AS k, count(*) OVER (PARTITION BY group_id, sample_id // 2) AS n FROM tok),
  c AS (SELECT a.group_id, a.sample_id // 2 AS pair, a.sample_id AS chosen, b.sample_id AS rejected, (a.logp - b.logp) - (a.old_logp - b.old_logp) AS h FROM p a JOIN p b ON a.group_id = b.group_id AND a.sample_id // 2 = b.sample_id // 2 AND a.k = 1 AND b.k = 2 WHERE a.n = 2)
  SELECT group_id, CAST(pair AS BIGINT) AS pair, chosen, rejected, round(0.9 * ln(1 + exp(-0.1 * h)) + 0.1 * ln(1 + exp(0.1 * h)), 6) AS dpo, round((h - 5.0) ** 2, 5) AS ipo FROM c""")
def dpo_pairs(spark, sf_dir):
    got = L.preference_pairs(tokens(spark, sf_dir))
    args = [F.col(f"{a}.{b}") for b in ("logp", "old_logp") for a in ("chosen", "rejected")]
    return got.select("group_id", F.col("pair").cast("long").alias("pair"), F.col("chosen.sample_id").alias("chosen"), F.col("rejected.sample_id").alias("rejected"), F.round(L.dpo(*args, smoothing=0.1), 6).alias("dpo"), F.round(L.dpo(*args, kind="ipo"), 5).alias("ipo"))


@query()
def policy_resampling(spark, sf_dir):
    """Draws are hashed, which SQL cannot repeat: rows only."""
    return L.resample(S.rollouts(spark, sf_dir), ["group_id", "sample_id"]).select(*OUT, "reward", "copies")


# ---- policies by name: a batch's loss and what was clipped ------------------------------------------

_WEIGHED = f"""{TOK}, t AS (SELECT *, logp - old_logp AS d, exp(logp - old_logp) AS r, sign(advantage) AS sg, 1 + sample_id % 3 / 4 AS w, exp(least(sum((logp - old_logp) * mask) OVER g / greatest(sum(mask) OVER g, 1), 10)) AS sr FROM tok WINDOW g AS (PARTITION BY group_id)),
  u AS (SELECT avg(advantage) FILTER (mask = 1) AS a, avg(logp) FILTER (mask = 1) AS l, greatest(floor(0.002 * sum(mask)), 1) AS k FROM t),
  c AS (SELECT t.*, k, row_number() OVER (PARTITION BY mask ORDER BY (advantage - a) * (logp - l) DESC, group_id, sample_id) AS nth FROM t, u),
  x AS (SELECT *, -advantage * r AS p1, -advantage * greatest(least(r, 1.2), 0.8) AS p2, -advantage * sr AS g1, -advantage * greatest(least(sr, 1.2), 0.8) AS g2, mask = 1 AND nth <= k AS top, sg * least(sg * d, sg * greatest(least(d, 0.2), -0.2)) AS held FROM c)"""
_MASKED = lambda e: f"round(sum(({e}) * mask) / (sum(mask) + 1e-8), 5) + 0.0"


def _policy_sql() -> str:
    worst = "CASE WHEN advantage < 0 THEN least(-advantage * 3, greatest(p1, p2)) ELSE greatest(p1, p2) END"
    row = lambda name, loss, clipped, kl, lower: f"SELECT '{name}' AS policy, {loss} AS loss, {clipped} AS clipped, {kl} AS kl, {lower} AS clipped_lower"
    by_seq = "SELECT group_id, sum(w * greatest(g1, g2) * mask) / (sum(mask) + 1e-8) AS s, exp(sum(held * mask) / (sum(mask) + 1e-8)) * -(sum(advantage * mask) / (sum(mask) + 1e-8)) * exp(sum(ln(w + 1e-10) * mask) / (sum(mask) + 1e-8)) AS q FROM x GROUP BY 1"
    out = "(d < -0.2 OR d > 0.2)"
    parts = [
        row("vanilla", _MASKED(f"w * {worst}"), _MASKED("(p2 > p1)::INT"), _MASKED("-d"), _MASKED("(greatest(p1, p2) > -advantage * 3 AND advantage < 0)::INT")) + " FROM x",
        row("gspo", "(SELECT round(avg(s), 5) + 0.0 FROM q)", _MASKED("(g2 > g1)::INT"), _MASKED("-d"), "0.0::DOUBLE") + " FROM x",
        row("gpg", _MASKED("w * -logp * advantage"), "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE") + " FROM x",
        row("kl_cov", _MASKED("w * (p1 + CASE WHEN top THEN abs(d) ELSE 0 END)"), "0.0::DOUBLE", _MASKED("abs(d)"), "0.0::DOUBLE") + " FROM x",
        row("geo_mean", "(SELECT round(avg(q), 5) + 0.0 FROM q)", _MASKED(f"({out} AND advantage > 0)::INT"), _MASKED("-d"), _MASKED(f"({out} AND advantage < 0)::INT")) + " FROM x",
    ]
    return f"{_WEIGHED}, q AS ({by_seq}) " + " UNION ALL ".join(parts)


@query(_policy_sql())
def policy_losses(spark, sf_dir):
    """Five policies over weighted tokens; the sixth draws at random."""
    # stored, as each policy reads them
    rows = cut(tokens(spark, sf_dir).drop("reward", "value"))
    batch, out = P.Batch(rows.withColumn("w", 1 + F.col("sample_id") % 3 / 4), weight="w"), None
    for name, options in {"vanilla": {}, "gspo": {}, "gpg": {}, "kl_cov": {"share": 0.002}, "geo_mean": {}}.items():
        one = P.policy_loss(name, batch, **options).select(F.lit(name).alias("policy"), *((F.round(c, 5) + 0.0).alias(c) for c in P.PARTS))
        out = one if out is None else out.unionByName(one)
    return out
