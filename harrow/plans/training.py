"""Queries of the remaining training-side operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import answers as N
from harrow.functions.expressions import value_text
from harrow.operators import joins as J
from harrow.operators import losses as L
from harrow.operators import metrics as M
from harrow.operators import shape as P
from harrow.plans import standins as S
from harrow.plans.advantages import TOK, tokens
from harrow.plans.registry import query, r6

ROLL = f"WITH {S.SQL['rollouts']}"


@query(f"{TOK} SELECT round(sum(-exp(logp - old_logp) * advantage * mask) / sum(mask), 6) + 0.0 AS tokens, (SELECT round(sum(s), 3) + 0.0 FROM (SELECT sum(-exp(logp - old_logp) * advantage * mask) / nullif(sum(mask), 0) AS s FROM tok GROUP BY group_id)) AS sequences FROM tok")
def analysis_losses(spark, sf_dir):
    t = tokens(spark, sf_dir)
    a = L.analysis_loss(t).select(r6("loss").alias("tokens"))
    return a.crossJoin(L.analysis_loss(t, over="sequences").select((F.round("loss", 3) + 0.0).alias("sequences")))


@query(f"{TOK} SELECT group_id, sample_id, round(-logp * advantage, 6) + 0.0 AS loss FROM tok")
def gpg_loss(spark, sf_dir):
    return tokens(spark, sf_dir).select("group_id", "sample_id", r6(-F.col("logp") * F.col("advantage")).alias("loss"))


@query()
def clip_cov(spark, sf_dir):
    """The dropped tokens are a hashed choice: rows only."""
    got = L.clip_cov(tokens(spark, sf_dir), ["group_id", "sample_id"], share=0.01, low=0.1)
    return got.select("group_id", "sample_id", r6("loss").alias("loss"), "dropped")


@query(f"{TOK} SELECT round(sum((old_logp - logp) * mask) / sum(mask), 6) + 0.0 AS kl FROM tok")
def masked_kl(spark, sf_dir):
    return M.masked_kl(tokens(spark, sf_dir), F.col("mask")).select(r6("kl").alias("kl"))


@query(f"{ROLL} SELECT group_id, sample_id, round(-(passed::INT * ln(1 / (1 + exp(-value))) + (1 - passed::INT) * ln(1 - 1 / (1 + exp(-value)))), 6) AS loss FROM rollouts")
def reward_model_ce(spark, sf_dir):
    return S.rollouts(spark, sf_dir).select("group_id", "sample_id", r6(L.reward_model_ce(F.col("value"), F.col("passed").cast("int"))).alias("loss"))


@query(f"""{ROLL} SELECT a.group_id, round(coalesce(sum(CASE WHEN (a.value - b.value) * (a.reward - b.reward) > 0 THEN abs(a.reward - b.reward) ELSE 0 END) / nullif(sum(abs(a.reward - b.reward)), 0), 0.5), 6) AS accuracy
  FROM rollouts a JOIN rollouts b ON a.group_id = b.group_id AND a.sample_id < b.sample_id GROUP BY 1""")
def preference_accuracy(spark, sf_dir):
    pairs = J.pairs_within(S.rollouts(spark, sf_dir), "group_id", "sample_id", ["value", "reward"])
    return L.preference_accuracy(pairs, "value_i", "value_j", "reward_i", "reward_j", ["group_id"]).select("group_id", r6("accuracy").alias("accuracy"))


@query("SELECT vec_id AS id, round(ln(list_sum([exp(CAST(x AS DOUBLE)) FOR x IN embedding])) - list_sum([exp(CAST(x AS DOUBLE)) * CAST(x AS DOUBLE) FOR x IN embedding]) / list_sum([exp(CAST(x AS DOUBLE)) FOR x IN embedding]), 6) AS entropy FROM embeddings")
def logits_entropy(spark, sf_dir):
    return S.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), r6(L.entropy(F.col("v"))).alias("entropy"))


@query("""WITH t AS (SELECT greatest(max(event_id) - 100, 1) AS n FROM events) SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN event_id / 100 ELSE greatest(0, 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (event_id - 100) / n))) END, 6) AS cosine,
  round(CASE WHEN event_id < 100 THEN event_id / 100 WHEN (event_id - 100) / n < 0.9 THEN 1 ELSE greatest(0, 1 - ((event_id - 100) / n - 0.9) / 0.1) END, 6) + 0.0 AS wsd FROM events, t""")
def learning_rates(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    s, total = F.col("event_id"), e.agg(F.max("event_id")).first()[0] or 0  # the schedule ends with the last event
    return e.select(s.alias("step"), r6(L.learning_rate(s, "cosine", 100, total, 0.1)).alias("cosine"), r6(L.learning_rate(s, "wsd", 100, total)).alias("wsd"))


@query("SELECT event_type, count(*) * 100 AS tokens, round(sum(abs(value)), 4) AS seconds, round(count(*) * 100 / (sum(abs(value)) * 8), 6) AS throughput, round(sum(abs(value)) * 1000 / (count(*) * 100), 6) AS ms_per_token FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").withColumns({"tokens": F.lit(100).cast("long"), "seconds": F.abs("value")})
    return M.throughput(e, "tokens", "seconds", 8, ["event_type"]).select("event_type", "tokens", F.round("seconds", 4).alias("seconds"), r6("throughput").alias("throughput"), r6("ms_per_token").alias("ms_per_token"))


@query(f"{ROLL} SELECT group_id, CAST(count(*) FILTER (masked_in AND old_logp <> logp) AS BIGINT) AS mismatches FROM rollouts GROUP BY 1")
def token_mismatches(spark, sf_dir):
    return S.sequences(spark, sf_dir).select("group_id", M.mismatches(F.col("old_logp"), F.col("logp"), F.col("mask")).alias("mismatches"))


@query(f"""{ROLL}, r AS (SELECT *, sum(reward) OVER (PARTITION BY group_id ORDER BY sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS run FROM rollouts)
  SELECT group_id, sample_id, round(reward / ((SELECT max(abs(run)) FROM r) + 1e-6), 6) AS reward FROM r""")
def reward_batch_norm(spark, sf_dir):
    return M.batch_norm(S.rollouts(spark, sf_dir), "reward").select("group_id", "sample_id", r6("reward").alias("reward"))


@query(f"{ROLL} SELECT group_id, sample_id, CASE WHEN reward > coalesce(lag(reward) OVER (PARTITION BY group_id ORDER BY sample_id), 0) THEN 0 ELSE -0.05 END::DOUBLE AS reward FROM rollouts")
def tool_step_reward(spark, sf_dir):
    rows = S.rollouts(spark, sf_dir).withColumnRenamed("reward", "score")
    return M.step_reward(rows, "score", "group_id", "sample_id").select("group_id", "sample_id", "reward")


@query("SELECT o_orderkey AS group_id, 'missing' AS error FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'duplicate' FROM orders WHERE o_orderkey % 14 = 3")
def worker_merge(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"))
    _, errors = M.merge_workers([o.where("group_id % 7 <> 0"), o.where("group_id % 14 = 3")], o)
    return errors


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def unlabelled_ids(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").exceptAll(S.table(spark, sf_dir, "labels").select("doc_id"))


@query(f"{ROLL} SELECT group_id, sample_id, pred FROM rollouts QUALIFY sample_id = 0 AND count(*) OVER (PARTITION BY group_id) > 2")
def sampled_columns(spark, sf_dir):
    """Samples of a prompt as one row, and back to rows: the first of those with more than two."""
    folded = S.rollouts(spark, sf_dir).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "pred"))).alias("r"))
    return folded.where(F.size("r") > 2).select("group_id", F.inline("r")).where("sample_id = 0")


@query("SELECT conv_id, string_agg('Doc ' || k || '(' || role || ') ' || left(text, 20), chr(10) ORDER BY k) AS results FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1")
def search_results(spark, sf_dir):
    chats = P.fold_chat(S.table(spark, sf_dir, "conversations"))
    lines = F.transform("messages", lambda m, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("("), m["role"], F.lit(") "), F.left(m["content"], F.lit(20))))
    return chats.select("conv_id", F.array_join(lines, "\n").alias("results"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) + 2 AS pieces, upper(left(p_type, 1)) || lower(p_type[2:]) AS name, replace(p_brand, '/', '-') || '_' || p_type AS safe FROM part")
def text_pieces(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    marked = F.concat(F.regexp_replace("p_name", " ", "<image>"), F.lit("<video>x"))
    pieces = F.size(P.segments(marked)) - F.size(F.split("p_name", " ")) + 1
    return p.select("p_partkey", pieces.cast("long").alias("pieces"), P.capitalized(F.col("p_type")).alias("name"), N.safe_name(F.col("p_brand"), F.col("p_type")).alias("safe"))


@query("SELECT o_orderkey, 'sum' AS name, '{\"a\":' || CAST(o_orderkey AS VARCHAR) || '}' AS arguments, 'before  after' AS rest FROM orders")
def tool_calls(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    text = F.concat(F.lit('before <tool_call>{"name":"sum","arguments":{"a":'), F.col("o_orderkey").cast("string"), F.lit("}}</tool_call> after<tool_call>{bad</tool_call>"))
    return o.select("o_orderkey", F.explode(N.tool_calls(text)).alias("c"), N.without_tool_calls(text).alias("rest")).select("o_orderkey", "c.name", "c.arguments", "rest")


@query("SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS answer FROM orders")
def minerva_normalize(spark, sf_dir):
    from pyspark.sql.functions import format_number

    o = S.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("x = $"), format_number(F.floor("o_totalprice"), 0), F.lit("$ dollars"))
    return o.select("o_orderkey", N.minerva_normal(text).alias("answer"))


@query("SELECT p_partkey, CAST(3 * p_size - 2 * (p_partkey % 9) + 4 AS BIGINT) AS value, CAST(p_size + 1 AS DOUBLE) / 2 AS quotient FROM part")
def expression_values(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    text = F.concat(F.col("p_size").cast("string"), F.lit("@"), (F.col("p_partkey") % 9).cast("string"), F.lit("+4"))
    half = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(" + 1) / 2"))
    return p.select("p_partkey", value_text(text).cast("long").alias("value"), N.arithmetic_value(half).alias("quotient"))


@query("SELECT user_id, count(*) AS queued, count(*) >= 60 OR sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) >= 16 * 2 AS pause FROM events GROUP BY 1")
def back_pressure(spark, sf_dir):
    from harrow.streaming.samples import should_pause

    n = S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("queued"), F.count_if(F.col("event_id") % 2 == 0).alias("flying"))
    return n.select("user_id", "queued", should_pause(F.col("queued"), F.col("flying"), 60, 16, 1, 1).alias("pause"))
