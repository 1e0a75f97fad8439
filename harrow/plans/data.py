"""Queries of sources, shaping, joins, packing, answers and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import answers as N
from harrow.functions import rewards as R
from harrow.operators import joins as J
from harrow.operators import search as Q
from harrow.operators import pack as U
from harrow.operators import shape as P
from harrow.operators import select as T
from harrow.plans import standins as S
from harrow.plans.registry import query, r6
from harrow.sources import files as I
from harrow.streaming import samples as W

ROLL = f"WITH {S.SQL['rollouts']}"


def docs(spark, sf_dir):
    return S.table(spark, sf_dir, "documents")


# ---- shaping -------------------------------------------------------------------------------------


@query("SELECT part.p_partkey, i AS sample_id FROM part, range(4) r(i)")
def expand_rollouts(spark, sf_dir):
    return P.expand(S.table(spark, sf_dir, "part").select("p_partkey"), 4)


@query("WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, i * 3 + k AS interleaved, k * n + i AS tiled FROM p, range(3) r(k)")
def repeat_tile(spark, sf_dir):
    rows = T.ranked(S.table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], "i").withColumn("i", F.col("i") - 1)
    n = rows.count()
    a = P.repeat(rows, 3, "i", name="interleaved").withColumn("tiled", (F.col("interleaved") % 3) * n + F.col("i"))
    return a.select("p_partkey", "interleaved", "tiled")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), m AS (SELECT max(n) AS n, CAST(ceil(max(n) / 384) * 384 AS BIGINT) AS size FROM d)
  SELECT doc_id, a AS at, a >= m.n AS pad FROM m, LATERAL (SELECT unnest(range(size)) AS a) JOIN d ON d.i = a % d.n""")
def pad_wrap(spark, sf_dir):
    rows = T.ranked(docs(spark, sf_dir).select("doc_id"), ["doc_id"], "i").withColumn("i", F.col("i") - 1)
    return P.pad_to(rows, 384, "i").select("doc_id", "at", "pad")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT i // 8 AS fold, i % 8 AS pos, doc_id FROM d")
def fold_unfold(spark, sf_dir):
    rows = T.ranked(docs(spark, sf_dir).select("doc_id"), ["doc_id"], "i").withColumn("i", F.col("i") - 1)
    return P.unfold(P.fold(rows, 8, "i", ["doc_id"]), ["doc_id"])


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, i FROM d WHERE i >= 10 AND i < 150 AND (i - 10) % 7 = 0")
def slice_step(spark, sf_dir):
    rows = T.ranked(docs(spark, sf_dir).select("doc_id"), ["doc_id"], "i").withColumn("i", F.col("i") - 1)
    return P.select_rows(rows, "i", 10, 150, 7)


@query("SELECT conv_id, sha256(string_agg('**' || upper(role[1]) || lower(role[2:]) || '**: ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations WHERE role <> 'system' GROUP BY 1")
def chat_fold(spark, sf_dir):
    chats = P.fold_chat(S.table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", F.sha2(P.flatten_chat(F.col("messages")), 256).alias("digest"), F.size(F.filter("messages", lambda m: m["role"] != "system")).cast("long").alias("turns"))


@query("SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) ELSE 0 END) AS BIGINT) AS ones, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1")
def chat_loss_mask(spark, sf_dir):
    chats = P.fold_chat(S.table(spark, sf_dir, "conversations")).select("conv_id", P.chat_mask(F.col("messages")).alias("m"))
    return chats.select("conv_id", F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x).alias("ones"), F.size("m").cast("long").alias("words"))


@query("SELECT conv_id, CAST(sum(CASE WHEN k > 1 THEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) ELSE 0 END) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1")
def token_estimate(spark, sf_dir):
    return P.fold_chat(S.table(spark, sf_dir, "conversations")).select("conv_id", N.estimated_tokens(F.col("messages")).alias("tokens"))


@query("SELECT p_partkey, 'Solve: ' || p_name || ' Answer True or False.' AS prompt, 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS options, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS letter, CAST(CAST(p_size AS INT) AS VARCHAR) AS answer FROM part")
def prompt_templates(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select("p_partkey", P.prompt(F.col("p_name"), "Solve:", F.lit(True)).alias("prompt"), P.choices(F.array("p_brand", "p_type")).alias("options"), P.answer_letter(F.lit(None).cast("string"), F.col("p_size") % 2).alias("letter"), P.integer_text(F.col("p_size").cast("double")).alias("answer"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
  SELECT 'parts' AS data_source, 'user' AS role, p_name AS content, p_brand AS ground_truth, 'train' AS split, i AS index FROM p""")
def prompt_records(spark, sf_dir):
    rows = P.prompt_records(S.table(spark, sf_dir, "part"), "parts", "p_partkey", "p_name", "p_brand", "train")
    return rows.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.split", "extra_info.index")


@query("WITH u AS (SELECT 'en' AS benchmark, 0 AS p, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'fr', 1, doc_id FROM documents WHERE lang = 'fr') SELECT benchmark, doc_id, row_number() OVER (ORDER BY p, doc_id) - 1 AS group_id FROM u")
def combined_input(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang")
    return P.combined_input([(x, d.where(F.col("lang") == x).select("doc_id")) for x in ("en", "fr")], "doc_id")


@query("SELECT p_partkey, unnest([p_name, p_type]) AS response, unnest([1, 0]) AS label FROM part")
def preference_unpivot(spark, sf_dir):
    return P.unpivot_preferences(S.table(spark, sf_dir, "part"), ["p_partkey"], "p_name", "p_type")


@query("""SELECT conv_id, list_sum(list_slice(t, 1, 6)) AS right_sum, list_sum(list_slice(t, greatest(len(t) - 5, 1), len(t))) AS left_sum, len(list_slice(t, 1, 6)) + greatest(8 - len(list_slice(t, 1, 6)), 0) AS padded
  FROM (SELECT conv_id, list(length(text) ORDER BY turn) AS t FROM conversations GROUP BY 1)""")
def pad_truncate(spark, sf_dir):
    t = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("t"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    right = P.fit_length(F.col("t"), 6)
    return t.select("conv_id", total(right).alias("right_sum"), total(P.fit_length(F.col("t"), 6, "left")).alias("left_sum"), F.size(P.pad(right, 8, F.lit(0))).cast("long").alias("padded"))


@query(f"""{ROLL}, s AS (SELECT group_id, sample_id, masked_in::INT AS m, sum(masked_in::INT) OVER (PARTITION BY group_id ORDER BY sample_id) AS c FROM rollouts) SELECT group_id, sample_id, CAST((c - 1) * m AS BIGINT) AS position FROM s""")
def position_ids(spark, sf_dir):
    got = S.sequences(spark, sf_dir).select("group_id", F.posexplode(P.position_ids(F.col("mask"))).alias("sample_id", "position"))
    return got.select("group_id", F.col("sample_id").cast("long").alias("sample_id"), F.col("position").cast("long").alias("position"))


# ---- joins ---------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT o_orderkey AS id, 'unknown' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION SELECT DISTINCT l_orderkey, 'missing' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0))
  , k2 AS (SELECT id, kind FROM k WHERE kind = 'missing' OR id % 50 <> 0) SELECT kind, count(*) AS n, array_to_string(list_slice(list_sort(list(id)), 1, 10), ',') AS first FROM k2 GROUP BY 1""")
def keyset_mismatch(spark, sf_dir):
    left = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).where("id % 50 <> 0")
    return J.key_difference(left, S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("SELECT l_orderkey, count(*) AS n, min(o_orderstatus) AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 GROUP BY 1")
def truth_override(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("truth"))
    truth = S.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("truth"))
    kept, _ = J.truth_override(rows, truth, "id", "truth")
    return kept.groupBy(F.col("id").alias("l_orderkey")).agg(F.count("*").alias("n"), F.min("truth").alias("truth"))


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents), e AS (SELECT vec_id AS group_id, embedding[1] AS score FROM embeddings) SELECT group_id, round(CAST(score AS DOUBLE), 6) + 0.0 AS score, doc_id FROM e LEFT JOIN d ON group_id = line")
def line_lookup(spark, sf_dir):
    lines = T.ranked(docs(spark, sf_dir).select("doc_id"), ["doc_id"], "line").withColumn("line", F.col("line") - 1)
    scores = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("group_id"), F.col("v")[0].alias("score"))
    return J.by_position(scores, lines).select("group_id", r6("score").alias("score"), "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf_dir):
    done = S.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unprocessed(S.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query(f"{ROLL}, a AS (SELECT group_id, avg(passed::INT) AS accuracy FROM rollouts GROUP BY 1) SELECT group_id, round(accuracy, 6) AS accuracy, CAST(label AS DOUBLE) AS score FROM a JOIN embeddings ON group_id = vec_id")
def accuracy_of_scored(spark, sf_dir):
    from harrow.operators.metrics import accuracy_by_group

    scores = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("group_id"), F.col("label").cast("double").alias("score"))
    return J.restricted(accuracy_by_group(S.rollouts(spark, sf_dir)), scores).select("group_id", r6("accuracy").alias("accuracy"), "score")


@query(f"""{ROLL} SELECT a.group_id, a.sample_id AS i, b.sample_id AS j, round(a.reward - b.reward, 6) + 0.0 AS gap FROM rollouts a JOIN rollouts b ON a.group_id = b.group_id AND a.sample_id < b.sample_id WHERE a.reward <> b.reward""")
def pairwise_gaps(spark, sf_dir):
    got = J.pairs_within(S.rollouts(spark, sf_dir), "group_id", "sample_id", ["reward"]).where("reward_i <> reward_j")
    return got.select("group_id", "i", "j", r6(F.col("reward_i") - F.col("reward_j")).alias("gap"))


@query(f"""{ROLL} SELECT group_id, sample_id, round(CASE WHEN passed THEN avg(value) FILTER (NOT passed) OVER g ELSE avg(value) FILTER (passed) OVER g END, 6) AS other_mean FROM rollouts WINDOW g AS (PARTITION BY group_id)""")
def leave_class_out(spark, sf_dir):
    return J.other_class_mean(S.rollouts(spark, sf_dir), "group_id", "passed", "value").select("group_id", "sample_id", F.round("other_mean", 6).alias("other_mean"))


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS id, list_dot_product(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p) SELECT query, id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 5""")
def nearest_documents(spark, sf_dir):
    v = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v")
    return Q.nearest(v.where("id % 50 = 0"), v, 5).select("query", "id", r6("score").alias("score"), "rank")


@query("""WITH t AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
  l AS (SELECT id, sum(tf) AS len FROM tf GROUP BY 1), w AS (SELECT avg(len) AS a, count(*) AS n FROM l), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT item_id AS query, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS term FROM benchmark),
  s AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / a))) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN l USING (id), w GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query, id, round(score, 5) AS score, rank FROM r WHERE rank <= 3""")
def bm25_topk(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    q = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return Q.bm25(q, d, 3).select("query", "id", F.round("score", 5).alias("score"), "rank")


# ---- packing: orders are groups, their quantity the cost, 2,000 orders a batch --------------------


def _costs(spark, sf_dir):
    g = S.rollouts(spark, sf_dir).groupBy("group_id").agg(F.sum("length").alias("cost"))
    return g.withColumn("batch", F.floor(F.col("group_id") / 2000))


@query()
def lpt_packing(spark, sf_dir):
    return U.pack(_costs(spark, sf_dir), 8, "batch", "group_id", "cost")


@query()
def karmarkar_karp(spark, sf_dir):
    return U.pack(_costs(spark, sf_dir), 8, "batch", "group_id", "cost", "kk")


@query()
def micro_batches(spark, sf_dir):
    return U.micro_batches(_costs(spark, sf_dir), 20_000, "batch", "group_id", "cost")


@query(f"{ROLL}, g AS (SELECT group_id, sum(length) AS cost FROM rollouts GROUP BY 1) SELECT group_id, CAST(cost AS BIGINT) AS cost, (row_number() OVER (PARTITION BY group_id // 2000 ORDER BY group_id, cost) - 1) % 8 AS shard FROM g")
def round_robin(spark, sf_dir):
    return U.round_robin(_costs(spark, sf_dir), 8, ["group_id", "cost"], "batch").select("group_id", "cost", "shard")


@query(f"{ROLL}, g AS (SELECT group_id, sum(length) AS cost FROM rollouts GROUP BY 1), s AS (SELECT group_id // 2000 AS batch, (row_number() OVER (PARTITION BY group_id // 2000 ORDER BY group_id) - 1) % 8 AS shard, cost FROM g), l AS (SELECT batch, sum(cost) AS load FROM s GROUP BY batch, shard) SELECT CAST(batch AS BIGINT) AS batch, CAST(min(load) AS BIGINT) AS least, CAST(max(load) AS BIGINT) AS most, round(avg(load), 6) AS mean FROM l GROUP BY 1")
def imbalance(spark, sf_dir):
    rows = U.round_robin(_costs(spark, sf_dir), 8, ["group_id"], "batch")
    return U.imbalance(rows, "shard", "cost", ["batch"]).select("batch", "least", "most", r6("mean").alias("mean"))


# ---- answers -------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(f"SELECT doc_id, sha256(array_to_string({_WORDS.format('text')}, ' ')) AS digest FROM documents")
def qa_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(N.qa_normal(F.col("text")), 256).alias("digest"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN array_to_string({_WORDS.format('p_name')}, ' ') = array_to_string({_WORDS.format('p_type')}, ' ') ELSE p_size % 3 = 1 END AS exact, contains(array_to_string({_WORDS.format('p_name')}, ' '), array_to_string({_WORDS.format('split_part(p_name, chr(32), 1)')}, ' ')) AS part FROM part")
def exact_match(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select("p_partkey", N.exact_match(F.col("p_name"), F.array("p_type", F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("The "), F.upper("p_name"), F.lit("!"))).when(F.col("p_size") % 3 == 2, F.concat("p_name", F.lit(" more"))).otherwise(F.col("p_brand")))).alias("exact"), N.contains_match(F.col("p_name"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("part"))


def _solved(spark, sf_dir):
    """Orders as responses that box their price."""
    o = S.table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    text = F.concat(F.lit("<think>so x = 1</think> The answer is \\boxed{"), price.cast("string"), F.lit("}. #### "), F.format_number(price, 0), F.lit("\nAnswer: "), F.chr(F.col("o_orderkey") % 4 + 65), F.lit("\n<answer>The "), F.col("o_orderstatus"), F.lit("</answer>"))
    return o.select("o_orderkey", price.alias("price"), text.alias("response"), "o_orderstatus")


@query("SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS boxed, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS flat, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS hash, chr(CAST(o_orderkey % 4 + 65 AS INT)) AS letter, 'The ' || o_orderstatus AS tag FROM orders")
def answer_extraction(spark, sf_dir):
    r = F.col("response")
    return _solved(spark, sf_dir).select("o_orderkey", N.boxed(r).alias("boxed"), N.boxed_flat(r).alias("flat"), N.hash_answer(r).alias("hash"), N.choice_letter(r).alias("letter"), N.tagged(r).alias("tag"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM orders")
def reward_dispatch(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    source = F.when(k == 0, "gsm8k").when(k == 1, "math").when(k == 2, "gpqa").otherwise("search_qa")
    truth = F.when(k < 2, F.col("price").cast("string")).when(k == 2, "A").otherwise(F.col("o_orderstatus"))
    return _solved(spark, sf_dir).select("o_orderkey", R.dispatch(source, F.col("response"), truth).alias("score"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS acc, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS pred, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS reward FROM orders")
def verified_reward(spark, sf_dir):
    truth = (F.col("price") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3) + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(7)).cast("string")
    return _solved(spark, sf_dir).select("o_orderkey", R.verified("response", truth).alias("v")).select("o_orderkey", "v.acc", "v.pred", "v.reward")


@query(f"{ROLL} SELECT group_id, sample_id, round(least(-(length - 30) / 20, 0), 6) + 0.0 AS penalty FROM rollouts")
def overlong_penalty(spark, sf_dir):
    return S.rollouts(spark, sf_dir).select("group_id", "sample_id", r6(N.overlong_penalty(F.col("length"), 50, 20)).alias("penalty"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 0.5 ELSE least(n_chars, 100) / 100 END AS reward_score, quality = 0 AS rescored FROM labels JOIN documents USING (doc_id)")
def idempotent_rescore(spark, sf_dir):
    d = S.table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    key = R.input_hash(F.col("doc_id"), F.col("n_chars"))
    stored = d.withColumns({"reward_score": F.lit(0.5), "reward_name": F.lit("length"), "reward_version": F.lit("1"), "reward_input": F.when(F.col("quality") == 1, key)})
    return R.rescored(stored, F.least("n_chars", F.lit(100)) / 100, key, "length", "1").select("doc_id", "reward_score", "rescored")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, text FROM documents)
  SELECT doc_id, round(least(0.03 * least(len(w), 20) + CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN 0.2 ELSE 0 END + CASE WHEN len(w) > 0 THEN 0.2 * len(list_distinct(w)) / len(w) ELSE 0 END, 1), 6) AS reward FROM w""")
def heuristic_reward(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(N.heuristic_reward(F.col("text"))).alias("reward"))


@query(f"{ROLL}, m AS (SELECT group_id, pred, avg(reward) AS s FROM rollouts WHERE pred IN ('RF', 'AF') GROUP BY ALL) SELECT group_id, round(sum(greatest(least(s * CASE pred WHEN 'RF' THEN 2.0 ELSE -0.5 END, 1), -1)), 6) + 0.0 AS reward FROM m GROUP BY 1")
def weighted_reward(spark, sf_dir):
    got = R.weighted(S.rollouts(spark, sf_dir), {"RF": 2.0, "AF": -0.5}, "group_id", "pred", "reward")
    return got.select("group_id", r6("reward").alias("reward"))


@query()
def character_bleu(spark, sf_dir):
    """Scores of neighbouring short texts; not in SQL."""
    c = S.table(spark, sf_dir, "conversations")
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    return pairs.select("a.conv_id", "a.turn", r6(N.bleu_score(F.col("a.text"), F.col("b.text"))).alias("bleu"))


# ---- sources -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, len(list(l_partkey)) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def token_codec(spark, sf_dir):
    ids = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("t"), F.count("*").cast("int").alias("c"))
    back = I.decoded(ids.withColumn("p", I.encode_tokens("t")), "p", "c", "ids")
    return back.select("l_orderkey", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""{ROLL}, a AS (SELECT group_id % 5 AS model, benchmark, avg(passed::INT) AS a FROM rollouts GROUP BY ALL)
  SELECT model, {', '.join(f"round(max(a) FILTER (benchmark = 'b{i}') * 100, 6) AS b{i}" for i in range(4))} FROM a GROUP BY 1""")
def leaderboard(spark, sf_dir):
    a = S.rollouts(spark, sf_dir).groupBy((F.col("group_id") % 5).alias("model"), "benchmark").agg(F.avg(F.col("passed").cast("int")).alias("a"))
    names = [f"b{i}" for i in range(4)]
    wide = I.leaderboard(a, ["model"], "benchmark", "a", names)
    return wide.select("model", *(F.col(n).cast("double").alias(n) for n in names))


# ---- streams, in their batch form ------------------------------------------------------------------


def _events(spark, sf_dir):
    return S.table(spark, sf_dir, "events").withColumn("version", W.version_of(F.col("event_id"), 100))


@query("SELECT user_id, count(*) AS produced, least(count(*), 40) AS held, greatest(count(*) - 40, 0) AS dropped FROM events GROUP BY 1")
def queue_totals(spark, sf_dir):
    return W.queue_totals(_events(spark, sf_dir), 40, "user_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 40 AS kept FROM events")
def queue_drop_oldest(spark, sf_dir):
    return W.kept_in_queue(_events(spark, sf_dir), 40, "user_id", "event_id").select("event_id", "kept")


@query("SELECT event_type, count(*) AS samples, count(*) FILTER (c - event_id // 100 >= 3) AS stale, max(c - event_id // 100) AS largest_lag FROM (SELECT *, event_id // 100 + user_id % 5 AS c FROM events) GROUP BY 1")
def staleness_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    return W.staleness_totals(W.staleness(e, F.col("version") + F.col("user_id") % 5, F.col("version"), 3), "event_type")


@query("SELECT event_id, CASE WHEN (k - 1) // 16 < n // 16 THEN (k - 1) // 16 END AS batch FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def batch_assembly(spark, sf_dir):
    return W.assembled(_events(spark, sf_dir), 16, "user_id", "event_id").select("event_id", "batch")


@query("SELECT event_id // 100 AS version, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def version_rollup(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.countDistinct("user_id").alias("users"))
