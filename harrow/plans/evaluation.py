"""Queries of metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import advantage as A
from harrow.operators import metrics as M
from harrow.plans import standins as S
from harrow.plans.registry import query, r6

ROLL = f"WITH {S.SQL['rollouts']}"


@query(f"{ROLL} SELECT group_id, count(*) AS total, count(*) FILTER (passed) AS correct, round(avg(passed::INT), 6) AS accuracy FROM rollouts GROUP BY 1")
def accuracy_by_problem(spark, sf_dir):
    return M.accuracy_by_group(S.rollouts(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query(f"{ROLL}, g AS (SELECT count(*) AS n, count(*) FILTER (passed) AS k FROM rollouts GROUP BY group_id) SELECT CAST(sum(n) AS BIGINT) AS samples, count(*) AS groups, round(sum(k) / sum(n), 6) AS accuracy, round(avg((k > 0)::INT), 6) AS best_of_n FROM g")
def best_of_n(spark, sf_dir):
    return M.overall(S.rollouts(spark, sf_dir)).select("samples", "groups", r6("accuracy").alias("accuracy"), r6("best_of_n").alias("best_of_n"))


_VOTE = "v AS (SELECT group_id, pred, count(*) AS n, min(sample_id) AS first, arg_min(passed, sample_id) AS passed FROM rollouts GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, first) AS k FROM v)"


@query(f"{ROLL}, {_VOTE} SELECT group_id, pred, passed FROM w WHERE k = 1")
def majority_vote(spark, sf_dir):
    return M.majority(S.rollouts(spark, sf_dir))


@query(f"""{ROLL}, v AS (SELECT benchmark, group_id, pred, count(*) AS n, min(sample_id) AS first, arg_min(passed, sample_id) AS p, count(*) FILTER (passed) AS k, sum(length) AS l FROM rollouts GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY benchmark, group_id ORDER BY n DESC, first) AS r FROM v), g AS (SELECT benchmark, group_id, sum(n) AS n, sum(k) AS k, sum(l) AS l, bool_or(p AND r = 1) AS maj FROM w GROUP BY ALL)
  SELECT benchmark, count(*) AS problems, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(k) AS BIGINT) AS correct, round(sum(k) / sum(n), 6) AS avg_at_n, round(avg((k > 0)::INT), 6) AS p_at_n, round(avg(maj::INT), 6) AS maj_at_n, round(sum(l) / sum(n), 6) AS mean_tokens FROM g GROUP BY 1""")
def eval_metrics(spark, sf_dir):
    got = M.evaluation(S.rollouts(spark, sf_dir), ["benchmark"])
    return got.select("benchmark", "problems", "samples", "correct", *(r6(c).alias(c) for c in ("avg_at_n", "p_at_n", "maj_at_n", "mean_tokens")))


@query(f"""{ROLL}, g AS (SELECT CASE WHEN grouping(benchmark) = 1 THEN 'overall' WHEN grouping(pred) = 1 THEN 'benchmark' ELSE 'category' END AS level, benchmark, pred AS category, avg(passed::INT) AS a, count(*) AS samples FROM rollouts GROUP BY GROUPING SETS ((benchmark), (benchmark, pred), ()))
  SELECT level, benchmark, category, round(a, 6) AS accuracy, samples FROM g UNION ALL SELECT 'macro', NULL, NULL, round(avg(a), 6), CAST(sum(samples) AS BIGINT) FROM g WHERE level = 'benchmark'""")
def macro_grouping_sets(spark, sf_dir):
    rows = S.rollouts(spark, sf_dir).withColumnRenamed("pred", "category")
    return M.macro(rows, "benchmark", "category").withColumn("accuracy", r6("accuracy"))


@query(f"""{ROLL}, g AS (SELECT benchmark, count(*) AS n, avg(reward) AS m, stddev_pop(reward) AS d FROM rollouts GROUP BY benchmark, group_id),
  l AS (SELECT benchmark, 'mean@' || n AS metric, m AS v FROM g UNION ALL SELECT benchmark, 'std@' || n, d FROM g WHERE n > 1) SELECT benchmark, metric, round(avg(v), 6) AS value FROM l GROUP BY ALL""")
def validation_mean_std(spark, sf_dir):
    return M.validation(S.rollouts(spark, sf_dir)).withColumn("value", r6("value"))


@query(f"""{ROLL}, c AS (SELECT group_id, reward, count(*) AS c FROM rollouts GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY group_id) AS n, sum(c) OVER (PARTITION BY group_id ORDER BY reward) AS u FROM c),
  k AS (SELECT *, unnest(list_append([x FOR x IN [2, 4, 8, 16, 32] IF x < n], n)) AS k FROM s WHERE n > 1)
  SELECT group_id, CAST(k AS BIGINT) AS k, round(sum(reward * ((u / n) ** k - ((u - c) / n) ** k)), 6) AS best, round(sum(reward * (((n - u + c) / n) ** k - ((n - u) / n) ** k)), 6) AS worst FROM k GROUP BY ALL""")
def bootstrap_best_expected(spark, sf_dir):
    return M.expected_extremes(S.rollouts(spark, sf_dir)).select("group_id", "k", r6("best").alias("best"), r6("worst").alias("worst"))


@query()
def bootstrap_resampled(spark, sf_dir):
    """Hashed resamples, which SQL cannot repeat: rows only."""
    got = M.bootstrap(S.rollouts(spark, sf_dir), 4, 50)
    return got.select("group_id", *(r6(c).alias(c) for c in ("best", "best_std", "worst", "worst_std")))


@query("SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events")
def score_summary(spark, sf_dir):
    got = M.summary(S.table(spark, sf_dir, "events"), "value")
    return got.select("count", *(r6(c).alias(c) for c in ("mean", "std", "min", "max")))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n FROM events, e GROUP BY 1)
  SELECT b AS bin, round(lo + b * ((hi - lo) / 20), 6) + 0.0 AS low, round(lo + (b + 1) * ((hi - lo) / 20), 6) + 0.0 AS high, coalesce(n, 0) AS count FROM e, range(20) AS r(b) LEFT JOIN c ON c.bin = b""")
def histogram(spark, sf_dir):
    return M.histogram(S.table(spark, sf_dir, "events"), "value").select("bin", r6("low").alias("low"), r6("high").alias("high"), "count")


@query(f"""{ROLL}, a AS (SELECT *, CASE WHEN count(*) OVER g = 1 THEN reward ELSE reward - avg(reward) OVER g END AS advantage FROM rollouts WINDOW g AS (PARTITION BY group_id))
  SELECT {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}_mean, round(CAST(max({c}) AS DOUBLE), 6) AS {c}_max, round(CAST(min({c}) AS DOUBLE), 6) + 0.0 AS {c}_min' for c in ('reward', 'advantage', 'value', 'length'))},
  round(avg((length >= 50)::INT), 6) AS clip_ratio, round(avg((length = 0)::INT), 6) AS aborted_ratio, round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) AS explained_variance FROM a""")
def data_metrics(spark, sf_dir):
    got = M.data_metrics(A.grpo(S.rollouts(spark, sf_dir), by_std=False), 50)
    return got.select(*(r6(c).alias(c) for c in got.columns))


def _metrics(spark, sf_dir):
    """Events as a long table of metrics."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "perf/max_latency").when(kind == "view", "perf/min_latency").when(kind == "purchase", "timing_s/step").otherwise(F.concat(F.lit("critic/avg_"), kind))
    return S.table(spark, sf_dir, "events").select(name.alias("metric"), "value", F.col("event_id").alias("step"), F.floor(F.col("event_id") / 500).alias("window"))


_LONG = "m AS (SELECT CASE event_type WHEN 'click' THEN 'perf/max_latency' WHEN 'view' THEN 'perf/min_latency' WHEN 'purchase' THEN 'timing_s/step' ELSE 'critic/avg_' || event_type END AS metric, value, event_id AS step, event_id // 500 AS win FROM events)"


@query(f"WITH {_LONG} SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM m GROUP BY 1")
def reduce_by_name(spark, sf_dir):
    return M.reduce_by_name(_metrics(spark, sf_dir)).withColumn("value", r6("value"))


@query(f"WITH {_LONG} SELECT CAST(win AS BIGINT) AS window, metric, round(CASE WHEN contains(metric, 'timing_s') THEN sum(value) WHEN contains(metric, 'avg') THEN avg(value) WHEN contains(metric, 'max') THEN max(value) ELSE min(value) END, 5) + 0.0 AS value FROM m GROUP BY win, metric")
def metric_rollup(spark, sf_dir):
    return M.roll_up(_metrics(spark, sf_dir), "window").withColumn("value", F.round("value", 5) + 0.0)


@query("""SELECT event_type, round(avg(value), 6) AS avg, round(max(value), 6) AS max, round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(DISTINCT event_id // 100) AS versions FROM events GROUP BY 1""")
def batch_percentiles(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").withColumn("version", F.floor(F.col("event_id") / 100))
    got = M.batch_statistics(rows, "value", "version", ["event_type"])
    return got.select("event_type", "versions", *(r6(c).alias(c) for c in ("avg", "max", "min", "p50", "p95", "p99")))


@query(f"{ROLL} SELECT group_id, count(*) AS count, round(CASE WHEN count(*) > 1 THEN avg(reward) ELSE 0 END, 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(greatest(var_samp(reward), 1e-6)) ELSE 1 END, 6) AS std FROM rollouts GROUP BY 1")
def group_mean_std(spark, sf_dir):
    return M.group_mean_std(S.rollouts(spark, sf_dir), "group_id", "reward").select("group_id", "count", r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def label_factorization(spark, sf_dir):
    return M.factorize(S.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


@query(f"""{ROLL}, m AS (SELECT value AS x, masked_in::INT AS m FROM rollouts), s AS (SELECT sum(x * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM m)
  SELECT round(sum(x * m), 4) AS sum, round(max(mean), 6) AS mean, round(sum((x - mean) ** 2 * m) / (max(n) + 1e-8) * max(n) / (max(n) - 1), 6) AS var FROM m, s""")
def masked_whiten(spark, sf_dir):
    got = M.masked_stats(S.rollouts(spark, sf_dir), "value", F.col("masked_in").cast("int"))
    return got.select(F.round("sum", 4).alias("sum"), r6("mean").alias("mean"), r6("var").alias("var"))


@query(f"""{ROLL}, d AS (SELECT exp(logp) AS a, exp(old_logp) AS b, abs(exp(logp) - exp(old_logp)) AS d FROM rollouts WHERE masked_in)
  SELECT round(corr(a, b), 6) + 0.0 AS correlation, round(max(d), 6) AS diff_max, round(avg(d), 6) AS diff_mean, round(stddev_samp(d), 6) AS diff_std FROM d""")
def logprob_correlation(spark, sf_dir):
    got = M.logprob_differences(S.rollouts(spark, sf_dir), "logp", "old_logp", F.col("masked_in").cast("int"))
    return got.select(*(r6(c).alias(c) for c in got.columns))


@query(f"{ROLL} SELECT group_id, count(*) AS n FROM rollouts GROUP BY 1 HAVING count(*) <> 4")
def incomplete_groups(spark, sf_dir):
    return M.incomplete_groups(S.rollouts(spark, sf_dir), 4)


@query(f"{ROLL} SELECT 6.0::DOUBLE * 600000000 * sum(length) + 12.0::DOUBLE * 1024 * 28 * sum(length * length) AS flops, CAST(sum(length) AS DOUBLE) AS tokens FROM rollouts")
def flops_estimate(spark, sf_dir):
    return M.flops(S.rollouts(spark, sf_dir), 1024, 28, 600_000_000)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS k FROM conversations) WHERE k = 1")
def latest_turn(spark, sf_dir):
    got = M.first_of(S.table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.desc(F.length("text"))])
    return got.select("conv_id", "turn", "role")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def distinct_first(spark, sf_dir):
    return M.distinct_first(S.table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"{ROLL} SELECT group_id % 8 AS shard, count(DISTINCT group_id) AS groups, count(*) AS rows, CAST(sum(length) AS BIGINT) AS tokens, max(length) AS longest FROM rollouts GROUP BY 1")
def shard_statistics(spark, sf_dir):
    return M.group_tokens(S.rollouts(spark, sf_dir).withColumn("shard", F.col("group_id") % 8), "shard")


@query("SELECT event_type, round(min(value * 2), 6) + 0.0 AS least, round(max(value * 2), 6) AS most, round(avg(value * 2), 6) AS mean, arg_max(event_id, (value, event_id)) AS event_id FROM events GROUP BY 1")
def slowest_sample(spark, sf_dir):
    got = M.slowest(S.table(spark, sf_dir, "events"), F.col("value") * 2, ["event_id"], ["event_type"])
    return got.select("event_type", r6("least").alias("least"), r6("most").alias("most"), r6("mean").alias("mean"), "event_id")
