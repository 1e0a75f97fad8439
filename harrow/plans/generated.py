"""Queries of record validation, shards, masks of turns, generators, curricula and expression tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harrow.functions import answers as N
from harrow.functions import expressions as E
from harrow.operators import chat as C
from harrow.operators import generate as G
from harrow.operators import metrics as M
from harrow.operators import records as R
from harrow.plans import standins as S
from harrow.plans.registry import query, r6
from harrow.sources import shards
from harrow.sources.tables import shared_dir
from harrow.streaming import curriculum as U

ROLL = "WITH " + S.SQL["rollouts"]

# ---- records whose stored values are sometimes wrong ------------------------------------------------


def _records(spark, sf_dir):
    """A record per order. The stored mean is that of two decimals, the deviation that of all samples, the kept tokens leave
    out what masks do, and lines over 40 count as truncated, though the number stored is of those over 45."""
    line = S.rollouts(spark, sf_dir)
    row = F.struct("sample_id", "reward", "length", "masked_in", "value")
    g = line.groupBy("group_id").agg(F.array_sort(F.collect_list(row)).alias("t"), F.round(F.avg("reward"), 2).alias("mean"), F.stddev_pop("reward").alias("std"), F.sum(F.when(F.col("masked_in"), F.col("length")).otherwise(0)).alias("kept"), F.count_if(F.col("length") > 45).alias("cut"), F.sum("value").alias("score"))
    t = F.col("t")
    of = lambda f: F.transform(t, f)
    length = lambda x: x["length"]
    stats = {
        "group_id": F.col("group_id"), "worker_rank": F.col("group_id") % 2, "svd_score_scope": F.lit("ffn_only"), "svd_score": F.col("score"), "svd_gradient_source": F.lit("raw"), "analysis_method": F.lit("effective_rank"),
        "global_indices": of(lambda x: x["sample_id"]), "response_tokens": of(length), "generated_response_tokens": of(length), "prompt_tokens": of(lambda x: F.lit(5).cast("long")), "input_tokens": of(length),
        "original_input_tokens": of(lambda x: x["length"] + F.when(x["length"] == 50, 6).otherwise(5)), "analysis_truncated_flags": of(lambda x: x["length"] > 40), "generation_hit_max_tokens_flags": of(lambda x: F.lit(False)),
        "generation_finish_reasons": of(lambda x: F.lit("stop")), "generation_stop_reasons": of(lambda x: F.lit("")), "requested_max_tokens": of(lambda x: F.lit(50).cast("long")), "rewards": of(lambda x: x["reward"]),
        "advantages": of(lambda x: (x["reward"] - F.col("mean")) / (F.col("std") + 1e-6)), "reward_mean": F.col("mean"), "reward_std": F.col("std"), "total_response_tokens": F.col("kept"), "analysis_truncated_responses": F.col("cut"),
        "generation_hit_max_tokens_responses": F.lit(0).cast("long"), "advantage_estimator": F.lit("grpo"), "norm_adv_by_std_in_grpo": F.lit(True), "advantage_epsilon": F.lit(1e-6), "advantage_std_correction": F.lit(1).cast("long"), "token_input_source": F.lit("inference_token_ids"),
    }
    families = ("Q", "K", "V", "O", "GATE", "UP", "DOWN")
    sums = F.create_map(*(x for f in families for x in (F.lit(f), F.col("score") if f == "UP" else F.lit(0.0))))
    spectrum = F.struct(F.lit("ffn_only").alias("score_scope"), F.col("score").alias("s"), sums.alias("per_family_layer_sum"), F.create_map(F.lit("qkvo_only"), F.lit(0.0), F.lit("ffn_only"), F.col("score"), F.lit("transformer_2d"), F.col("score")).alias("scores_by_scope"))
    matrix = F.struct(*(F.lit(0.5).alias(k) for k in R.STATISTICS))
    whole = {"record_schema_version": F.lit(5), "worker_rank": F.col("group_id") % 2, "analysis_method": F.lit("effective_rank"), "gradient_parameter_scope": F.lit("transformer_2d"), "svd_gradient_source": F.lit("raw"), "svd_score_scope": F.lit("ffn_only"), "matrices": F.create_map(F.lit("a"), matrix), "effective_rank_topk": spectrum, "group_stats": F.struct(*(v.alias(k) for k, v in stats.items()))}
    # as lines, whose absent fields are read as null, made and read in one task; a generator, so that a check's use of a field isn't a parse of its own
    line = g.select(F.to_json(F.struct("group_id", *(v.alias(k) for k, v in whole.items()))).alias("line"))
    return line.select(F.inline(F.array(F.from_json("line", R.SCHEMA))))


@query(f"""{ROLL}, g AS (SELECT group_id, count(*) AS n, round(avg(reward), 2) AS m, avg(reward) AS mean, stddev_pop(reward) AS p, CASE WHEN count(*) = 1 THEN 1.0 ELSE stddev_samp(reward) END AS s, sum(CASE WHEN masked_in THEN length ELSE 0 END) AS kept, sum(length) AS total,
    count(*) FILTER (length > 40) AS cut, count(*) FILTER (length > 45) AS stored, count(*) FILTER (length = 50) AS odd, any_value(reward) AS one FROM rollouts GROUP BY 1),
  f AS (SELECT group_id, list_filter([CASE WHEN kept <> total THEN 'total_response_tokens is not the sum of response_tokens' END,
    CASE WHEN abs(m - CASE WHEN n = 1 THEN 0 ELSE mean END) > 1e-6 * greatest(abs(m), CASE WHEN n = 1 THEN 0 ELSE abs(mean) END, 1) THEN 'reward_mean is not that of the rewards' END,
    CASE WHEN abs(p - s) > 1e-6 * greatest(p, s, 1) THEN 'reward_std is not that of the rewards' END,
    CASE WHEN odd > 0 THEN 'a response''s tokens are not prompt and generated tokens' END,
    CASE WHEN cut <> stored THEN 'analysis_truncated_responses is not the number of flags' END], lambda x: x IS NOT NULL) AS l FROM g)
  SELECT group_id, array_to_string(l, '; ') AS faults FROM f WHERE len(l) > 0""")
def record_faults(spark, sf_dir):
    got = R.faults(_records(spark, sf_dir), F.size("group_stats.rewards"), F.col("group_id") % 2)
    return got.where(F.size("faults") > 0).select("group_id", F.array_join("faults", "; ").alias("faults"))


@query(f"{ROLL} SELECT group_id, count(*) AS n, round(avg(reward), 6) AS reward, CAST(sum(length) AS BIGINT) AS tokens FROM rollouts GROUP BY 1")
def shard_round_trip(spark, sf_dir):
    """All rollouts written as shards; of what is read back, three members are unpacked."""
    n = F.col("length")
    row = {"input_ids": F.sequence(F.lit(1).cast("long"), n), "attention_mask": F.array_repeat(F.lit(1).cast("long"), n.cast("int")), "response_mask": F.array_repeat(F.lit(1).cast("long"), n.cast("int")), "original_input_length": n, "was_truncated": ~F.col("masked_in"), "prompt_length": F.lit(0).cast("long"), "generated_response_length": n, "generation_hit_max_tokens": n >= 50}
    row |= {"generation_finish_reason": F.lit("stop"), "generation_stop_reason": F.col("pred"), "requested_max_tokens": F.lit(50).cast("long"), "global_index": F.col("sample_id"), "reward_score": F.col("reward")}
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    shards.write_shards(S.rollouts(spark, sf_dir).select("group_id", *(v.alias(k) for k, v in row.items())), path)
    back = shards.read_shards(spark, path, ["group_id", "reward_score", "input_ids"])
    return back.groupBy("group_id").agg(F.count("*").alias("n"), r6(F.avg("reward_score")).alias("reward"), F.sum(F.size("input_ids")).alias("tokens"))


# ---- chats: in every fourth, all after the first answer comes from tools; every fifth has masks of its own


_CHATS = """c AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn >= 2 THEN 'tool' WHEN conv_id % 11 = 3 AND turn = 1 THEN 'critic' ELSE role END AS role, text, CASE WHEN conv_id % 5 = 0 THEN turn % CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 2 END END AS flag FROM conversations),
  o AS (SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"""


def _chats(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    role = F.when((conv % 4 == 1) & (turn >= 2), "tool").when((conv % 11 == 3) & (turn == 1), "critic").otherwise(F.col("role"))
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), "text", F.when(conv % 5 == 0, turn % F.when(conv % 3 == 0, 3).otherwise(2)).cast("int").alias("flag"))


@query(f"""WITH {_CHATS}, p AS (SELECT *, sum(CASE WHEN role = 'tool' AND before = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS part FROM o),
  g AS (SELECT conv_id, CAST(part AS BIGINT) AS part, arg_min(role, pos) AS role, count(*) AS messages, arg_min(coalesce(flag, -1), pos) AS flag, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS n FROM p GROUP BY ALL)
  SELECT conv_id, part, role, messages, CAST(n + 2 AS BIGINT) AS tokens, CAST(CASE WHEN flag >= 0 THEN flag * (n + 2) WHEN role = 'assistant' THEN n + 1 ELSE 0 END AS BIGINT) AS ones FROM g""")
def turn_masks(spark, sf_dir):
    got = C.parts(_chats(spark, sf_dir), override="flag")
    return got.select("conv_id", "part", "role", F.col("messages").cast("long").alias("messages"), F.size("tokens").cast("long").alias("tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


@query(f"""WITH {_CHATS}, b AS (SELECT conv_id, pos, CASE WHEN role = 'system' AND pos > 1 THEN 'a system message after the first' WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'unknown role ' || role
    WHEN NOT (role = 'tool' AND before IS NOT DISTINCT FROM 'tool') AND flag NOT IN (0, 1) THEN 'a mask other than 0 or 1' END AS bad FROM o),
  f AS (SELECT conv_id, arg_min(bad, pos) FILTER (bad IS NOT NULL) AS bad FROM b GROUP BY 1), s AS (SELECT conv_id, string_agg(role, ',' ORDER BY pos) FILTER (pos <= 3) || ',' AS s FROM o GROUP BY 1)
  SELECT conv_id, coalesce(bad, 'the beginning is not user, assistant') AS fault FROM f JOIN s USING (conv_id) WHERE bad IS NOT NULL OR NOT (s LIKE 'user,assistant,%' OR s = 'system,user,assistant,')""")
def chat_faults(spark, sf_dir):
    return C.faults(_chats(spark, sf_dir), override="flag")


# ---- generators -------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders WHERE o_custkey IS NOT NULL)
  SELECT o_custkey, o_orderkey, o_orderpriority AS text, false AS made FROM o UNION ALL SELECT o_custkey, o_orderkey + 1000000000000, before || '+' || o_orderpriority, true FROM o WHERE length(before || '+' || o_orderpriority) <= 16""")
def generated_rows(spark, sf_dir):
    """Neighbouring orders of a customer make a new one; long texts are left out."""
    o = S.table(spark, sf_dir, "orders").where("o_custkey is not null").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("text"))
    return G.appended(o, G.chained("o_orderkey", "text", "+", 10**12), ["o_custkey"], ["o_orderkey"], F.length("text") <= 16)


_UNIT = lambda seed, key, place="": f"(('0x' || substr(md5('{seed}:' || {key} || ':{place}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def _sql_expression(key: str, seed: int) -> str:
    """Text and value of expressions of 2 or 3 terms with @ alone, one level deep."""

    def number(place):
        return f"CAST(floor(1 + {_UNIT(seed, key, place + 'n')} * 9) AS BIGINT)"

    def whole(place, terms):
        three = f"floor({_UNIT(seed, key, place + 'k')} * 2) = 1"
        (a, x), (b, y), (c, z) = terms
        return f"({a} || ' @ ' || {b} || CASE WHEN {three} THEN ' @ ' || {c} ELSE '' END)", f"(CASE WHEN {three} THEN 3 * (3 * {x} - 2 * {y}) - 2 * {z} ELSE 3 * {x} - 2 * {y} END)"

    def term(place):
        text, value = whole(place + ".", [(f"CAST({number(f'{place}.{i}')} AS VARCHAR)", number(f"{place}.{i}")) for i in range(3)])
        return f"CASE WHEN {_UNIT(seed, key, place + 'p')} < 0.5 THEN '(' || {text} || ')' ELSE CAST({number(place)} AS VARCHAR) END", f"(CASE WHEN {_UNIT(seed, key, place + 'p')} < 0.5 THEN {value} ELSE {number(place)} END)"

    text, value = whole("", [term(str(i)) for i in range(3)])
    return f"{text} AS expression, CAST({value} AS VARCHAR) AS answer"


@query(f"SELECT *, CAST(length(expression) - length(replace(expression, '@', '')) AS INT) AS tool_calls FROM (SELECT DISTINCT p_partkey, {_sql_expression('p_partkey', 7)} FROM part)")
def expression_tasks(spark, sf_dir):
    return E.tasks(S.table(spark, sf_dir, "part").select("p_partkey").distinct(), "p_partkey", seed=7).drop("prompt")


# ---- curriculum -------------------------------------------------------------------------------------

_WEIGHTS = f"""{ROLL}, b AS (SELECT group_id, reward, row_number() OVER (PARTITION BY group_id ORDER BY sample_id DESC) - 1 AS back FROM rollouts),
  s AS (SELECT CAST(group_id AS VARCHAR) AS prompt, count(*) AS seen, sum(0.2 * pow(0.8, back) * reward) + 0.5 * pow(0.8, count(*)) AS success FROM b GROUP BY 1), w AS (SELECT *, success * (1 - success) + 0.01 AS weight FROM s)"""


def _weights(spark, sf_dir):
    rows = S.rollouts(spark, sf_dir).select(F.col("group_id").cast("string").alias("prompt"), F.col("sample_id").alias("seq"), F.col("reward").alias("result"))
    return U.weights(rows, rate=0.2)


@query(f"{_WEIGHTS} SELECT prompt, seen, round(success, 6) + 0.0 AS success, round(weight, 6) + 0.0 AS weight FROM w")
def curriculum_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("prompt", "seen", r6("success").alias("success"), r6("weight").alias("weight"))


@query(f"{_WEIGHTS} SELECT prompt FROM w ORDER BY -ln(1 - {_UNIT('0.3', 'prompt')}) / weight, prompt LIMIT 256")
def curriculum_draw(spark, sf_dir):
    """A step's batch of 256 prompts, by weight."""
    return U.drawn(_weights(spark, sf_dir), 256, step=3).select("prompt")


# ---- answers and metrics ----------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT p_partkey, CAST(p_size AS BIGINT) AS n, p_name FROM part)
  SELECT p_partkey, p_partkey % 6 <> 5 AS matched, CASE p_partkey % 6 WHEN 5 THEN p_name WHEN 4 THEN CAST(n AS VARCHAR) || '/2' ELSE CAST(n AS VARCHAR) END AS answer, p_partkey % 6 NOT IN (4, 5) AS correct FROM p WHERE NOT regexp_matches(p_name, '[0-9=:.]|be |is |are |get ')""")
def marked_answers(spark, sf_dir):
    """Sentences about a part's size, marked in six ways; the last has no number."""
    kind, n, name = F.col("p_partkey") % 6, F.col("p_size").cast("long").cast("string"), F.col("p_name")
    text = (
        F.when(kind == 0, F.concat(name, F.lit(": the answer is "), n))
        .when(kind == 1, F.concat(F.lit("ANSWER: "), n, F.lit(". "), name))
        .when(kind == 2, F.concat(n, F.lit(" is the answer for "), name))
        .when(kind == 3, F.concat(name, F.lit(r" has \boxed{x = "), n, F.lit("} in all")))
        .when(kind == 4, F.concat(F.lit("We get "), n, F.lit("/2")))
        .otherwise(name)
    )
    p = S.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name").distinct().where(~name.rlike("[0-9=:.]|be |is |are |get "))
    return p.select("p_partkey", N.marked(text).alias("m"), N.equals_any(text, F.array(F.lit("none"), n)).alias("correct")).select("p_partkey", "m.*", "correct")


_TOKENS = f"""{ROLL}, t AS (SELECT group_id, reward, value, reward - 0.5 AS advantage, CASE WHEN masked_in THEN 1 ELSE 0 END AS m FROM rollouts),
  g AS (SELECT group_id, sum(reward) AS score, sum(reward) - 0.25 * count(*) AS reward, sum(m) AS n, count(*) AS k FROM t GROUP BY 1)"""


@query(f"""{_TOKENS}, a AS (SELECT {", ".join(f"avg({x}) AS {y}_mean, max({x}) AS {y}_max, min({x}) AS {y}_min" for x, y in (("CASE WHEN n > 0 THEN score END", "score"), ("CASE WHEN n > 0 THEN reward END", "rewards"), ("n", "len"), ("CASE WHEN n > 0 THEN n END", "alive"), ("k", "prompt")))},
    avg((n = 6)::INT) AS len_clip, avg(CASE WHEN n > 0 THEN (n = 6)::INT END) AS alive_clip, avg((n = 0)::INT) AS aborted, avg((k = 7)::INT) AS prompt_clip FROM g),
  b AS (SELECT {", ".join(f"avg({x}) AS {y}_mean, max({x}) AS {y}_max, min({x}) AS {y}_min" for x, y in (("advantage", "adv"), ("reward", "ret"), ("value", "val")))}, 1 - var_samp(reward - value) / (var_samp(reward) + 1e-5) AS vf FROM t WHERE m = 1)
  SELECT metric, round(value, 5) + 0.0 AS value FROM ({" UNION ALL ".join(f"SELECT '{name}' AS metric, CAST({c} AS DOUBLE) AS value FROM {t}" for t, name, c in [(t, f"{n}/{k}", f"{c}_{k}") for t, n, c in (("a", "critic/score", "score"), ("a", "critic/rewards", "rewards"), ("a", "response_length", "len"), ("a", "response_length_non_aborted", "alive"), ("a", "prompt_length", "prompt"), ("b", "critic/advantages", "adv"), ("b", "critic/returns", "ret"), ("b", "critic/values", "val")) for k in ("mean", "max", "min")] + [("a", "response_length/clip_ratio", "len_clip"), ("a", "response_length_non_aborted/clip_ratio", "alive_clip"), ("a", "response/aborted_ratio", "aborted"), ("a", "prompt_length/clip_ratio", "prompt_clip"), ("b", "critic/vf_explained_var", "vf")])})""")
def sequence_metrics(spark, sf_dir):
    """An order is a sequence; what its masks keep is its response, and none where they keep nothing."""
    s = S.sequences(spark, sf_dir).withColumnsRenamed({"value": "values", "reward": "returns"})
    total = F.aggregate("returns", F.lit(0.0), lambda a, x: a + x)
    kept = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = s.select("returns", "values", "mask", F.transform("returns", lambda x: x - 0.5).alias("advantages"), total.alias("score"), (total - 0.25 * F.size("returns")).alias("reward"), kept.alias("response_length"), F.size("returns").cast("long").alias("prompt_length"))
    return M.sequence_metrics(rows, 6, 7).select("metric", F.round(F.round("value", 5) + F.lit(0.0), 5).alias("value"))
