"""Queries of reports over responses and metrics, whitened and detached losses, batches and record shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import answers as N
from harrow.functions import rewards as R
from harrow.operators import advantage as A
from harrow.operators import joins as J
from harrow.operators import losses as L
from harrow.operators import metrics as M
from harrow.operators import pack as K
from harrow.operators import select as T
from harrow.operators import shape as P
from harrow.plans import standins as S
from harrow.plans.advantages import TOK, tokens
from harrow.plans.registry import query, r6

ROLL = "WITH " + S.SQL["rollouts"]


@query(f"{ROLL} SELECT benchmark, count(*) AS samples, count(*) FILTER (pred = 'NF') AS invalid, count(*) FILTER (pred = 'AF') AS errors, count(*) FILTER (length >= 48) AS at_limit, round(avg(length), 6) AS mean_tokens FROM rollouts GROUP BY 1")
def response_counts(spark, sf_dir):
    r = S.rollouts(spark, sf_dir)
    return M.response_counts(r, ["benchmark"], F.col("pred") == "NF", F.col("pred") == "AF", 48).withColumn("mean_tokens", r6("mean_tokens"))


@query(f"""{ROLL}, g AS (SELECT group_id, list({{'vote': pred, 'val': CAST(passed AS INT)}} ORDER BY sample_id) AS v FROM rollouts GROUP BY 1),
  d AS (SELECT group_id, d, j, v[CAST(('0x' || md5('42-' || d || '-' || j)[1:7])::BIGINT % len(v) + 1 AS INT)] AS x FROM g, range(20) a(d), range(4) b(j)),
  c AS (SELECT group_id, d, x.vote AS vote, count(*) AS n, min(j) AS first, arg_min(x.val, j) AS val FROM d GROUP BY 1, 2, 3),
  w AS (SELECT group_id, d, arg_max(val, n * 100 - first) AS won FROM c GROUP BY 1, 2)
  SELECT group_id, round(avg(won), 6) AS majority, round(stddev_pop(won), 6) AS majority_std FROM w GROUP BY 1""")
def bootstrap_majority(spark, sf_dir):
    return M.bootstrap_votes(S.rollouts(spark, sf_dir), 4, 20).select("group_id", r6("majority").alias("majority"), r6("majority_std").alias("majority_std"))


@query(f"{ROLL}, p AS (SELECT benchmark, group_id, avg(reward) AS score FROM rollouts GROUP BY 1, 2) SELECT benchmark, count(*) AS prompts, round(avg(score), 6) AS score FROM p GROUP BY 1")
def source_means(spark, sf_dir):
    return M.source_means(S.rollouts(spark, sf_dir), "benchmark", "group_id", "reward").withColumn("score", r6("score"))


@query("""WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), c AS (SELECT CAST(least(floor((p_size - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS b, count(*) AS n, bool_or(p_retailprice > 1000) AS held FROM part, e GROUP BY 1)
  SELECT b AS bin, coalesce(n, 0) AS count, coalesce(held, false) AS holds_chosen FROM range(20) AS r(b) LEFT JOIN c USING (b)""")
def flagged_histogram(spark, sf_dir):
    return M.flagged_histogram(S.table(spark, sf_dir, "part"), "p_size", F.col("p_retailprice") > 1000).select("bin", "count", "holds_chosen")


@query("""WITH s AS (SELECT event_type AS t, sum(value) AS s, count(*) AS n FROM events GROUP BY 1)
  SELECT 'timing_s/' || t AS metric, round(s, 4) AS value FROM s UNION ALL SELECT 'timing_per_token_ms/' || t, round(s * 1000 / (n * 64), 4) FROM s""")
def stage_times(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").withColumn("tokens", F.lit(64).cast("long"))
    return M.stage_times(e, "event_type", "value", "tokens").withColumn("value", F.round("value", 4))


_NAMES = ["global_seqlen/max", "global_seqlen/min", "global_seqlen/minmax_diff", "perf/total_num_tokens", "perf/time_per_step", "perf/throughput", "timing_s/gen", "timing_s/step"]


@query(f"""WITH m AS (SELECT event_id // 1000 AS win, {_NAMES}[CAST(event_id % 8 + 1 AS INT)] AS metric, max(value) + 1 AS value FROM events GROUP BY 1, 2),
  p AS (SELECT win, {', '.join(f"max(value) FILTER (metric = '{n}') AS m{i}" for i, n in enumerate(_NAMES))} FROM m GROUP BY 1)
  SELECT CAST(win AS BIGINT) AS win, metric, round(value, 6) AS value FROM m WHERE metric NOT IN ('global_seqlen/minmax_diff', 'perf/throughput')
  UNION ALL SELECT win, 'global_seqlen/minmax_diff', round(m0 - m1, 6) + 0.0 FROM p WHERE m2 IS NOT NULL AND m0 - m1 IS NOT NULL
  UNION ALL SELECT win, 'global_seqlen/minmax_diff', round(m2, 6) FROM p WHERE m2 IS NOT NULL AND m0 - m1 IS NULL
  UNION ALL SELECT win, 'perf/throughput', round(coalesce(m3 / (m4 * 8), m5), 6) FROM p WHERE m5 IS NOT NULL
  UNION ALL SELECT win, 'trainer/idle_ratio', round(m6 / m7, 6) FROM p WHERE m6 / m7 IS NOT NULL""")
def derived_metrics(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 8 + 1).cast("int"))
    m = S.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("win"), name.alias("metric")).agg((F.max("value") + 1).alias("value"))
    return M.derived_metrics(m, ["win"], 8).withColumn("value", r6("value"))


@query("SELECT l_returnflag, count(*) FILTER (l_linenumber % 3 > 0) AS partial, round(avg((l_linenumber % 3 > 0)::INT), 6) AS partial_ratio, CAST(max(l_linenumber % 3) AS INT) AS longest_span FROM lineitem GROUP BY 1")
def partial_statistics(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumn("end", (F.col("l_linenumber") + F.col("l_linenumber") % 3).cast("int"))
    got = M.partial_statistics(rows.withColumn("l_linenumber", F.col("l_linenumber").cast("int")), "l_linenumber", "end", ["l_returnflag"])
    return got.withColumn("partial_ratio", r6("partial_ratio"))


@query("WITH l AS (SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS label FROM part) SELECT p_partkey, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM l")
def coerced_labels(spark, sf_dir):
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 2, F.concat(F.lit(" "), "p_brand")).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(".0"))).otherwise(F.concat(size, F.lit(".0000000001")))
    return M.factorize(S.table(spark, sf_dir, "part").select("p_partkey", M.coerced_label(raw).alias("label")), "label")


_SHAPE = {"hidden": 64, "layers": 4, "heads": 8, "kv_heads": 2, "head_dim": 8, "intermediate": 256, "vocabulary": 1000}


@query(f"{ROLL} SELECT 6.0::DOUBLE * (4 * (64 * (2 * 64 + 2 * 16) + 3 * 64 * 256) + 2 * 1000 * 64) * sum(length) + 12.0::DOUBLE * 64 * 4 * sum(length * length) AS flops, CAST(sum(length) AS DOUBLE) AS tokens FROM rollouts")
def decoder_flops(spark, sf_dir):
    return M.decoder_flops(S.rollouts(spark, sf_dir), _SHAPE)


@query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def distinct_json(spark, sf_dir):
    return M.distinct_by_json(S.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"], "p_partkey")


def _white(rows: str, of: str) -> str:
    return f"""w AS (SELECT sum(x * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM {rows}), v AS (SELECT any_value(mean) AS mean, sum((x - mean) ** 2 * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM {rows}, w)
  SELECT group_id, sample_id, round((x - mean) / sqrt(var + 1e-8) * m, 6) + 0.0 AS {of} FROM {rows}, v"""


_STEPS = f"""WITH RECURSIVE {S.SQL["rollouts"]}, t AS (SELECT group_id, sample_id, reward AS r, value AS v, CASE WHEN masked_in THEN 1 ELSE 0 END AS m, count(*) OVER (PARTITION BY group_id) - 1 - sample_id AS k FROM rollouts)"""


def _token_rows(rows, column):
    got = rows.select("group_id", F.posexplode(F.arrays_zip(F.col(column).alias("x"), F.col("mask").alias("m"))).alias("sample_id", "z"))
    return got.select("group_id", F.col("sample_id").cast("long").alias("sample_id"), F.col("z.x").alias("advantage"), F.col("z.m").alias("m"))


@query(_STEPS + """, scan AS (SELECT group_id, k, r AS got, r * m AS run FROM t WHERE k = 0
  UNION ALL SELECT t.group_id, t.k, t.r + 0.9 * s.run, (t.r + 0.9 * s.run) * t.m FROM scan s JOIN t ON t.group_id = s.group_id AND t.k = s.k + 1),
  x AS (SELECT t.group_id, t.sample_id, s.got AS x, t.m FROM scan s JOIN t USING (group_id, k)), """ + _white("x", "advantage"))
def reinforce_pp_whitened(spark, sf_dir):
    rows = _token_rows(A.reinforce_returns(S.sequences(spark, sf_dir)), "returns")
    return A.whitened_returns(rows, "advantage", F.col("m")).select("group_id", "sample_id", r6("advantage").alias("advantage"))


@query(_STEPS + """, scan AS (SELECT group_id, k, CASE WHEN m = 1 THEN v ELSE 0.0::DOUBLE END AS nxt, CASE WHEN m = 1 THEN r - v ELSE 0.0::DOUBLE END AS run FROM t WHERE k = 0
  UNION ALL SELECT t.group_id, t.k, CASE WHEN t.m = 1 THEN t.v ELSE s.nxt END, CASE WHEN t.m = 1 THEN t.r + 0.9 * s.nxt - t.v + 0.9 * 0.95 * s.run ELSE s.run END FROM scan s JOIN t ON t.group_id = s.group_id AND t.k = s.k + 1),
  x AS (SELECT t.group_id, t.sample_id, s.run AS x, t.m FROM scan s JOIN t USING (group_id, k)), """ + _white("x", "advantage"))
def gae_whitened(spark, sf_dir):
    rows = _token_rows(A.gae(S.sequences(spark, sf_dir)), "advantages")
    return A.whitened_returns(rows, "advantage", F.col("m")).select("group_id", "sample_id", r6("advantage").alias("advantage"))


@query(f"""{ROLL}, s AS (SELECT *, count(*) OVER g AS n, sum(reward) OVER g AS tr, sum(value) OVER g AS tv FROM rollouts WINDOW g AS (PARTITION BY group_id)),
  a AS (SELECT group_id, sample_id, masked_in::INT AS m, CASE WHEN n = 1 THEN reward + 0.5 * value ELSE (reward - (tr - reward) / (n - 1)) + 0.5 * (value - (tv - value) / (n - 1)) END AS a FROM s),
  x AS (SELECT group_id, sample_id, m, sum(a) OVER (PARTITION BY group_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM a), """ + _white("x", "advantage"))
def prime_whitened(spark, sf_dir):
    rows = A.prime_rewards(S.rollouts(spark, sf_dir), {"reward": 1.0, "value": 0.5})
    got = A.whitened_returns(A.reverse_sums(rows, "advantage", "group_id", "sample_id"), "advantage", F.col("masked_in").cast("int"))
    return got.select("group_id", "sample_id", r6("advantage").alias("advantage"))


@query(f"""{TOK}, w AS (SELECT group_id, avg(exp(logp - old_logp)) AS w FROM tok WHERE mask = 1 GROUP BY 1)
  SELECT round(avg(w), 6) AS seq_mean, round(coalesce(stddev_samp(w), 0), 6) AS seq_std, round(max(w), 6) AS seq_max, round(min(w), 6) AS seq_min, round(max(abs(w - 1)), 6) AS seq_max_deviation, round(avg((w > 1.1)::INT), 6) AS seq_share_high, round(avg((w < 0.9)::INT), 6) AS seq_share_low FROM w""")
def sequence_weights(spark, sf_dir):
    got = L.sequence_weights(tokens(spark, sf_dir).withColumn("weight", F.exp(F.col("logp") - F.col("old_logp"))), "group_id", 0.9, 1.1)
    return got.select(*(r6(c).alias(c) for c in got.columns))


@query(f"""{TOK}, s AS (SELECT group_id, -avg(old_logp) AS t, -avg(logp) AS r FROM tok WHERE mask = 1 GROUP BY 1)
  SELECT round(avg(exp(t)), 6) AS train_ppl, round(avg(t), 6) AS train_log_ppl, round(avg(exp(r)), 6) AS rollout_ppl, round(avg(r), 6) AS rollout_log_ppl, round(avg(t - r), 6) + 0.0 AS log_ppl_diff, round(avg(abs(t - r)), 6) AS log_ppl_abs_diff, round(max(t - r), 6) + 0.0 AS log_ppl_diff_max, round(min(t - r), 6) + 0.0 AS log_ppl_diff_min, round(avg(exp(t - r)), 6) AS ppl_ratio FROM s""")
def perplexities(spark, sf_dir):
    got = L.perplexities(tokens(spark, sf_dir), "group_id", "old_logp", "logp")
    return got.select(*(r6(c).alias(c) for c in got.columns))


@query(f"""{ROLL}, o AS (SELECT *, CASE WHEN passed THEN avg(value) FILTER (NOT passed) OVER g ELSE avg(value) FILTER (passed) OVER g END AS other, count(*) OVER g AS n,
    count(*) OVER (PARTITION BY group_id ORDER BY value) AS upto FROM rollouts WINDOW g AS (PARTITION BY group_id)),
  l AS (SELECT *, ln(1 + exp(-2 * (value - coalesce(other, 0)) * CASE WHEN passed THEN 1 ELSE -1 END)) AS loss FROM o)
  SELECT group_id, sample_id, round(loss, 6) AS loss, round(loss * n * pow(upto / n, n - 1), 6) AS best_of_loss FROM l""")
def detached_dpo(spark, sf_dir):
    plain = L.detached_dpo(S.rollouts(spark, sf_dir), "value", "passed", "group_id", 2.0).withColumnRenamed("loss", "plain")
    both = L.detached_dpo(plain, "value", "passed", "group_id", 2.0, best_of="value")
    return both.select("group_id", "sample_id", r6("plain").alias("loss"), r6("loss").alias("best_of_loss"))


@query(f"{ROLL} SELECT benchmark, round(avg((sign(value - 0.3) = sign(CAST(passed AS INT) * 2 - 1))::INT), 6) AS accuracy FROM rollouts GROUP BY 1")
def absolute_accuracy(spark, sf_dir):
    r = S.rollouts(spark, sf_dir).withColumns({"score": F.col("value") - 0.3, "truth": F.col("passed").cast("int")})
    return L.absolute_accuracy(r, "score", "truth", ["benchmark"]).withColumn("accuracy", r6("accuracy"))


@query(f"""{ROLL}, g AS (SELECT *, avg(passed::INT) OVER w BETWEEN 0.2 AND 0.8 AND max(length) OVER w < 49 AS ok FROM rollouts WINDOW w AS (PARTITION BY group_id)),
  r AS (SELECT *, row_number() OVER (ORDER BY ok DESC, group_id, sample_id) AS k, count(*) OVER () AS n FROM g) SELECT group_id, sample_id FROM r WHERE k <= floor(n * 0.25)""")
def prime_filter_truncated(spark, sf_dir):
    return T.untruncated_accuracy(S.rollouts(spark, sf_dir), 0.2, 0.8, 50, 0.25).select("group_id", "sample_id")


@query(f"""{ROLL}, v AS (SELECT *, group_id % 7 AS batch, stddev_pop(reward) OVER (PARTITION BY group_id) > 0 OR count(*) OVER (PARTITION BY group_id) = 1 AS ok FROM rollouts),
  g AS (SELECT batch, group_id, row_number() OVER (ORDER BY batch, group_id) AS k FROM (SELECT DISTINCT batch, group_id FROM v WHERE ok AND batch < 5))
  SELECT batch, group_id, sample_id FROM v JOIN g USING (batch, group_id) WHERE k <= (SELECT count(DISTINCT l_orderkey) // 5 FROM lineitem)""")
def accumulated_groups(spark, sf_dir):
    r = S.rollouts(spark, sf_dir).withColumn("batch", F.col("group_id") % 7)
    need = r.agg(F.countDistinct("group_id")).first()[0] // 5
    return T.accumulated_groups(r, need, 5).select("batch", "group_id", "sample_id")


@query("SELECT c_nationkey, any_value(n_name) AS n_name, any_value(n_regionkey) AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agreed_metadata(spark, sf_dir):
    rows = S.table(spark, sf_dir, "customer").join(S.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.agreed(rows, ["c_nationkey"], ["n_name", "n_regionkey"])


@query("SELECT o_orderkey, o_custkey, 0 AS made FROM orders UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_totalprice > 200000")
def appended_rows(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").withColumn("made", F.lit(0))
    return P.append_kept(o.select("o_orderkey", "o_custkey", "made"), o.withColumn("made", F.lit(1)), F.col("o_totalprice") > 200000)


@query("""WITH d AS (SELECT vec_id, vec_id // 64 AS batch, vec_id % 8 AS shard FROM embeddings)
  SELECT batch, vec_id, row_number() OVER (PARTITION BY batch ORDER BY shard, vec_id) - 1 AS place, row_number() OVER (PARTITION BY batch ORDER BY vec_id) - 1 AS origin FROM d""")
def inverse_order(spark, sf_dir):
    d = S.table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("batch"), (F.col("vec_id") % 8).alias("shard"))
    return K.inverse_order(d, "shard", "vec_id", "batch").select("batch", "vec_id", "place", "origin")


@query("""WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS a, p_size % 3 + 1 AS b, p_size % 5 + 1 AS c FROM part)
  SELECT p_partkey, CAST(least(a + b + 1, 6) AS BIGINT) AS chosen_tokens, CAST(least(a + c + 1, 6) AS BIGINT) AS rejected_tokens, CAST(CASE WHEN a + b < 6 THEN a + b + 1 ELSE 0 END AS BIGINT) AS chosen_end FROM p""")
def preference_inputs(spark, sf_dir):
    ids = lambda n, of: F.sequence(F.lit(of), F.lit(of - 1) + n)
    size = F.col("p_size").cast("int")
    got = S.table(spark, sf_dir, "part").select("p_partkey", P.preference_input(ids(size % 4 + 1, 10), ids(size % 3 + 1, 20), ids(size % 5 + 1, 30), 2, 6).alias("x"))
    ones = lambda i: F.aggregate(F.get("x.attention_mask", F.lit(i)), F.lit(0), lambda s, m: s + m).cast("long")
    return got.select("p_partkey", ones(0).alias("chosen_tokens"), ones(1).alias("rejected_tokens"), F.array_position(F.get("x.input_ids", F.lit(0)), 2).alias("chosen_end"))


@query("WITH d AS (SELECT count(*) AS n, CAST(ceil(count(*) / 384) * 384 AS BIGINT) AS size FROM embeddings) SELECT least(a, n - 1) AS vec_id, a AS at, a >= n AS pad FROM d, LATERAL (SELECT unnest(range(size)) AS a)")
def pad_with_last(spark, sf_dir):
    return P.pad_with_end(S.table(spark, sf_dir, "embeddings").select("vec_id"), 384, "vec_id").select("vec_id", "at", "pad")


@query("WITH w AS (SELECT * FROM (VALUES (0, 5), (1, 5), (2, 0), (3, -1)) AS v(place, vec_id)), n AS (SELECT count(*) AS n FROM embeddings) SELECT CAST(place AS BIGINT) AS \"at\", label, e.vec_id FROM w, n JOIN embeddings e ON e.vec_id = CASE WHEN w.vec_id < 0 THEN n + w.vec_id ELSE w.vec_id END")
def rows_at(spark, sf_dir):
    return P.rows_at(S.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", [5, 5, 0, -1]).select("at", "label", "vec_id")


@query("SELECT vec_id FROM embeddings JOIN labels ON vec_id = doc_id WHERE quality = 1")
def rows_by_mask(spark, sf_dir):
    mask = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") == 1).alias("flag"))
    return P.rows_where(S.table(spark, sf_dir, "embeddings").select("vec_id"), mask, "vec_id", "flag")


@query("SELECT p_partkey, p_size || ',' || (p_size + 0.5) AS answers FROM part")
def comma_answers(spark, sf_dir):
    x = F.col("p_size").cast("double")
    return S.table(spark, sf_dir, "part").select("p_partkey", P.comma_answers(F.array(x, x + 0.5)).alias("answers"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 30 THEN CASE WHEN l_linenumber = 1 THEN -0.5 ELSE 1 / sqrt(2 * 2) END ELSE 1 / sqrt(2) END, 6) AS reward FROM lineitem")
def box_rewards(spark, sf_dir):
    q, far = F.col("l_quantity").cast("double"), F.lit(500.0)
    points = F.array(F.struct(F.when(q > 30, far).otherwise(q).alias("x"), q.alias("y")), F.struct(F.when(F.col("l_linenumber") == 1, far).otherwise(q).alias("x"), q.alias("y")))
    got = N.box_reward(points, F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0))
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(got).alias("reward"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS in_line FROM orders")
def points_in_line(spark, sf_dir):
    k = (F.col("o_orderkey") % 100 + 1).cast("double")
    off = F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(1.0)
    points = [(F.lit(0.0), F.lit(0.0)), (k, k * k), (k * 2, k * k * 2 + off)]
    return S.table(spark, sf_dir, "orders").select("o_orderkey", N.in_line(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in points))).alias("in_line"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'qwen' WHEN 1 THEN 'llama' WHEN 2 THEN 'mistral' ELSE lower(p_brand) END AS family FROM part")
def model_families(spark, sf_dir):
    key = F.element_at(F.array(F.lit("Qwen2.5-7B"), F.lit("Meta-Llama-3"), F.lit("Mixtral-8x7B"), F.concat("p_brand", F.lit("-7b"))), (F.col("p_size") % 4 + 1).cast("int"))
    return S.table(spark, sf_dir, "part").select("p_partkey", N.model_family(key).alias("family"))


@query("""SELECT doc_id, round(CAST(CASE doc_id % 4 WHEN 0 THEN CASE WHEN r THEN 0.8 ELSE 0 END WHEN 1 THEN CASE WHEN r THEN 2.0 ELSE 0 END WHEN 2 THEN -0.2 + CASE WHEN r THEN 0.8 ELSE 0 END ELSE -0.2 END AS DOUBLE), 6) + 0.0 AS score
  FROM (SELECT doc_id, quality = 1 AS r FROM labels)""")
def tool_scores(spark, sf_dir):
    kinds = ["<think>a</think><answer>b</answer>", "<think>a</think><tool_call>x</tool_call><answer>b</answer>", "<think>a<answer>b</answer>", "<think>a</think><answer>" + "b" * 1000 + "</answer>"]
    text = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 4 + 1).cast("int"))
    return S.table(spark, sf_dir, "labels").select("doc_id", r6(N.tool_score(text, F.col("quality") == 1)).alias("score"))


@query("SELECT o_orderkey, [NULL, 'no box', 'no brace', 'unbalanced'][CAST(o_orderkey % 4 + 1 AS INT)] AS fault, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_custkey WHEN 1 THEN 'f' WHEN 2 THEN 'x' END AS answer FROM orders")
def box_faults(spark, sf_dir):
    kinds = F.array(F.concat(F.lit("is \\boxed{a"), F.col("o_custkey").cast("string"), F.lit("}")), F.lit("is \\fbox{f}"), F.lit("$\\boxed x$ is"), F.lit("\\boxed{x{y}"))
    text = F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", N.boxed_fault(text).alias("fault"), N.boxed_or_spaced(text).alias("answer"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS correct, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS format, CAST(o_custkey AS VARCHAR) AS answer FROM orders")
def step_scores(spark, sf_dir):
    """The truth of an odd order lies outside the tolerance of numbers, however large the key: that of key + 1 doesn't from 10,000 on."""
    key = F.col("o_custkey")
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("Step 2: ")).otherwise(F.lit("so ")), F.lit("\\boxed{"), key.cast("string"), F.lit("}"))
    truth = (key + F.col("o_orderkey") % 2 * (key + 1)).cast("string")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", R.step_score(text, truth).alias("s")).select("o_orderkey", "s.*")


@query("SELECT o_orderkey, o_orderstatus AS \"info/status\", o_orderpriority AS \"info/tool/name\" FROM orders")
def flat_records(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("name")).alias("tool")).alias("info"))
    return P.flat(o)


@query(r"""WITH h AS (SELECT c_custkey, [('0x' || md5('7-' || c_custkey || '-c' || i)[1:7])::BIGINT % 26 FOR i IN range(1, CAST(('0x' || md5('7-' || c_custkey || '-n')[1:7])::BIGINT % 8 + 4 AS INT))] AS l FROM customer),
  w AS (SELECT c_custkey, array_to_string([chr(CAST(97 + x AS INT)) FOR x IN l], '') AS word, chr(CAST(97 + l[CAST(('0x' || md5('7-' || c_custkey || '-t')[1:7])::BIGINT % len(l) + 1 AS INT)] AS INT)) AS letter FROM h)
  SELECT c_custkey, word, letter, CAST(len(word) - len(replace(word, letter, '')) AS INT) AS answer, CASE WHEN ('0x' || md5('7-' || c_custkey || '-s')[1:7])::BIGINT % 1000 < 900 THEN 'train' ELSE 'test' END AS split FROM w""")
def counting_tasks(spark, sf_dir):
    # few bytes and much to do for each: a small file is one task otherwise
    c = S.table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    return c.select("c_custkey", P.counting_task(F.col("c_custkey"), 7).alias("t")).select("c_custkey", "t.word", "t.letter", "t.answer", "t.split")


@query("SELECT o_orderkey, o_custkey FROM orders")
def matching_ids(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    return T.same_ids(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey"), "o_orderkey")


@query(f"""{ROLL}, p AS (SELECT a.group_id, a.benchmark, sum(abs(a.reward - b.reward)) AS gap, sum(CASE WHEN (a.value > b.value) = (a.reward > b.reward) THEN abs(a.reward - b.reward) ELSE 0 END) AS hit
  FROM rollouts a JOIN rollouts b ON a.group_id = b.group_id AND a.sample_id < b.sample_id GROUP BY 1, 2) SELECT group_id, round(CASE WHEN sum(gap) = 0 THEN 0.5 ELSE sum(hit) / sum(gap) END, 6) AS accuracy FROM p GROUP BY 1""")
def pair_accuracy(spark, sf_dir):
    pairs = J.pairs_within(S.rollouts(spark, sf_dir), "group_id", "sample_id", ["value", "reward"])
    return L.preference_accuracy(pairs, "value_i", "value_j", "reward_i", "reward_j", ["group_id"]).withColumn("accuracy", r6("accuracy"))
