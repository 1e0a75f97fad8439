"""Queries of filters, record shapes, masks and small joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.functions import answers as N
from harrow.operators import advantage as A
from harrow.operators import align as G
from harrow.operators import joins as J
from harrow.operators import losses as L
from harrow.operators import metrics as M
from harrow.operators import pack as K
from harrow.operators import select as T
from harrow.operators import shape as P
from harrow.plans import standins as S
from harrow.plans.registry import query, r6

ROLL = "WITH " + S.SQL["rollouts"]
_COORDS = "WITH " + S.SQL["coords"]


@query("SELECT p_partkey, coalesce(nullif(upper(trim(CASE WHEN p_size % 2 = 0 THEN ' ' || p_type[1] || ' ' WHEN p_size % 3 = 0 THEN ' ' END)), ''), chr(CAST(p_size % 4 + 65 AS INT))) AS letter FROM part")
def answer_letters(spark, sf_dir):
    given = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.left("p_type", F.lit(1)), F.lit(" "))).when(F.col("p_size") % 3 == 0, " ")
    return S.table(spark, sf_dir, "part").select("p_partkey", P.answer_letter(given, F.col("p_size") % 4).alias("letter"))


@query("SELECT doc_id, 'en' AS asked FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'test' FROM documents")
def split_or_whole(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return P.split_or_whole(d, F.col("lang"), "en").select("doc_id", F.lit("en").alias("asked")).union(P.split_or_whole(d, F.col("lang"), "test").select("doc_id", F.lit("test")))


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND contains(p_name, 'widget')")
def category_filter(spark, sf_dir):
    return P.matching(S.table(spark, sf_dir, "part"), {"p_type": "ECONOMY"}, {"p_name": "widget"}).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'")
def date_range(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.dated(o, "day", "1995-01-01", "1997-07-01").select("o_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def labelled_rows(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumn("label", F.nullif("l_returnflag", F.lit("N"))).withColumn("label", F.coalesce("label", F.lit("")))
    return P.labelled(rows, "label").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT vec_id, vec_id // CAST(ceil(count(*) OVER () / 8) AS BIGINT) AS chunk FROM embeddings")
def chunk_of(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings").select("vec_id")
    return e.withColumn("chunk", P.chunk_of("vec_id", 8, e.count(), padded=True))


@query("WITH t AS (SELECT p_partkey, ' ' || p_name || ' [title]' || p_type || '  [x' || p_brand || '] end' AS t FROM part) SELECT p_partkey, replace(regexp_replace(replace(trim(t), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS clean, upper(t[2]) || lower(t[3:]) AS capital FROM t")
def clean_choices(spark, sf_dir):
    t = F.concat(F.lit(" "), "p_name", F.lit(" [title]"), "p_type", F.lit("  [x"), "p_brand", F.lit("] end"))
    return S.table(spark, sf_dir, "part").select("p_partkey", P.clean_choice(t).alias("clean"), P.capitalized(F.substr(t, F.lit(2))).alias("capital"))


@query("""WITH o AS (SELECT p_partkey, list_sort([{'h': md5('7-' || p_partkey || '-' || i), 'i': i, 'x': [p_name, p_brand, p_type, p_name || '!'][i + 1]} FOR i IN range(4)]) AS o FROM part)
  SELECT p_partkey, array_to_string([x.x FOR x IN o], '|') AS options, chr(CAST(list_position([x.i FOR x IN o], 0) AS INT) + 64) AS letter FROM o""")
def shuffled_options(spark, sf_dir):
    got = P.shuffled_options(F.array("p_name", "p_brand", "p_type", F.concat("p_name", F.lit("!"))), F.col("p_partkey"), 7)
    return S.table(spark, sf_dir, "part").select("p_partkey", got.alias("g")).select("p_partkey", F.array_join("g.options", "|").alias("options"), F.col("g.letter").alias("letter"))


@query("SELECT o_orderkey, o_orderstatus || '/tool' AS style, o_orderpriority AS split, o_custkey % 3 = 0 AS need_tools, 'calc' AS tool FROM orders")
def tool_metadata(spark, sf_dir):
    extra = F.struct(F.col("o_orderpriority").alias("split"), F.struct(F.lit("none").alias("name")).alias("tool"))
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", extra.alias("extra"))
    o = o.withColumn("extra", P.with_fields(F.col("extra"), style=F.concat("o_orderstatus", F.lit("/tool")), need_tools=F.col("o_custkey") % 3 == 0, tool__name=F.lit("calc")))
    return o.select("o_orderkey", "extra.style", "extra.split", "extra.need_tools", F.col("extra.tool.name").alias("tool"))


@query(f"{ROLL} SELECT group_id, string_agg(pred, ' ' ORDER BY sample_id) AS responses FROM rollouts GROUP BY 1")
def sample_transposition(spark, sf_dir):
    return P.sampled_rows(S.rollouts(spark, sf_dir), "group_id", "sample_id", "pred").select("group_id", F.array_join("responses", " ").alias("responses"))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def column_union(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    return J.column_union(c.select("c_custkey", "c_nationkey", "c_acctbal"), c.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")


@query("WITH h AS (SELECT p_brand AS name FROM part WHERE p_size > 45 UNION SELECT p_type FROM part) SELECT p_partkey, CASE WHEN p_brand IN (SELECT name FROM h) THEN p_brand ELSE p_type END AS found FROM part")
def first_name(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    have = p.where("p_size > 45").select(F.col("p_brand").alias("name")).union(p.select("p_type"))
    return J.first_name(p, have, F.array(F.concat("p_brand", F.lit("x")), "p_brand", "p_type"), "p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def rows_of_selected(spark, sf_dir):
    ids = S.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return T.rows_of(ids, S.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"{ROLL} SELECT group_id, sample_id, row_number() OVER (ORDER BY group_id, sample_id) AS place FROM rollouts")
def sorted_samples(spark, sf_dir):
    rows = T.by_sample(S.rollouts(spark, sf_dir).select("group_id", "sample_id"))
    return T.ranked(rows, ["group_id", "sample_id"], "place")


@query(f"{ROLL} SELECT group_id, sample_id, greatest(length - 1 - sample_id, 0) AS ones, CASE WHEN length - 1 > sample_id THEN sample_id + 1 ELSE 0 END AS first FROM rollouts")
def sft_mask(spark, sf_dir):
    mask = P.sft_mask((F.col("sample_id") + 1).cast("int"), F.col("length").cast("int"))
    got = S.rollouts(spark, sf_dir).select("group_id", "sample_id", mask.alias("m"))
    return got.select("group_id", "sample_id", F.aggregate("m", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"), F.array_position("m", 1).alias("first"))


@query(f"{ROLL} SELECT group_id, count(*) FILTER (masked_in) AS n, round(coalesce(sum(value) FILTER (masked_in), 0), 6) AS total FROM rollouts GROUP BY 1")
def unpadded_values(spark, sf_dir):
    got = S.sequences(spark, sf_dir).select("group_id", P.unpadded(F.col("value"), F.col("mask")).alias("v"))
    return got.select("group_id", F.size("v").cast("long").alias("n"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(f"{ROLL} SELECT group_id, round(coalesce(sum(reward) FILTER (sample_id < 2), 0) - (6 - least(2, count(*))), 6) AS total FROM rollouts GROUP BY 1")
def placed_scores(spark, sf_dir):
    got = S.sequences(spark, sf_dir).select("group_id", P.place(F.col("reward"), F.lit(2), 6).alias("v"))
    return got.select("group_id", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("WITH p AS (SELECT p_partkey, p_size % 7 + 1 AS a, p_size % 5 + 1 AS b FROM part) SELECT p_partkey, CAST(least(8, a + b) AS BIGINT) AS n, CAST(greatest(least(8, a + b) - a, 0) AS BIGINT) AS ones, a + b > 8 AS was_truncated FROM p")
def assembled_inputs(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select("p_partkey", F.sequence(F.lit(1), F.col("p_size") % 7 + 1).alias("p"), F.sequence(F.lit(100), F.col("p_size") % 5 + 100).alias("r"))
    got = p.select("p_partkey", *(c.alias(n) for n, c in P.assemble(F.col("p"), F.col("r"), 8).items()))
    return got.select("p_partkey", F.size("input_ids").cast("long").alias("n"), F.aggregate("response_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"), "was_truncated")


@query(f"{ROLL}, n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sample_id DESC) AS back FROM rollouts) SELECT group_id, CAST(least(count(*), 3) AS BIGINT) AS n, CAST(coalesce(sum(masked_in::INT) FILTER (back <= 3), 0) AS BIGINT) AS ones FROM n GROUP BY 1")
def attention_response_mask(spark, sf_dir):
    got = S.sequences(spark, sf_dir).select("group_id", P.response_mask(F.col("mask"), 3).alias("m"))
    return got.select("group_id", F.size("m").cast("long").alias("n"), F.aggregate("m", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"))


@query(f"""{ROLL}, m AS (SELECT DISTINCT benchmark AS source, CASE WHEN passed THEN 'acc' ELSE 'len' END AS variable, CASE sample_id % 3 WHEN 0 THEN 'mean@' WHEN 1 THEN 'std@' ELSE 'best@' END || (length % 5) AS metric FROM rollouts),
  n AS (SELECT *, CAST(split_part(metric, '@', 2) AS INT) AS n FROM m)
  SELECT source, variable, metric, CASE WHEN variable = 'acc' AND n = max(n) OVER (PARTITION BY source, variable) AND NOT starts_with(metric, 'std') THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || variable || '/' || metric AS name FROM n""")
def validation_names(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("mean@"), F.lit("std@"), F.lit("best@")), (F.col("sample_id") % 3 + 1).cast("int"))
    m = S.rollouts(spark, sf_dir).select(F.col("benchmark").alias("source"), F.when(F.col("passed"), "acc").otherwise("len").alias("variable"), F.concat(kind, (F.col("length") % 5).cast("string")).alias("metric"))
    return M.name_validation(m.distinct())


_GROUPS = f"{ROLL}, g AS (SELECT group_id AS id, min(reward) = max(reward) AS zero_advantage, avg(value) FILTER (passed) AS score FROM rollouts GROUP BY 1)"


@query(f"{_GROUPS} SELECT id, round(CASE WHEN zero_advantage THEN 0.0 ELSE coalesce(score, 0.0) END, 6) AS score FROM g")
def shortcut_scores(spark, sf_dir):
    r = S.rollouts(spark, sf_dir).withColumnRenamed("group_id", "id")
    groups = r.groupBy("id").agg((F.min("reward") == F.max("reward")).alias("zero_advantage"))
    return G.shortcut(r.where("passed").groupBy("id").agg(F.avg("value").alias("score")), groups).select("id", r6("score").alias("score"))


@query(f"{ROLL}, a AS (SELECT *, reward - avg(reward) OVER (PARTITION BY group_id) AS advantage FROM rollouts) SELECT group_id, round(coalesce(sum(advantage * value) FILTER (abs(advantage) >= 0.001), 0), 6) + 0.0 AS score FROM a GROUP BY 1")
def small_advantages_dropped(spark, sf_dir):
    r = S.rollouts(spark, sf_dir).withColumn("advantage", F.col("reward") - F.avg("reward").over(W.partitionBy("group_id")))
    scores = G.without_small(r).groupBy("group_id").agg(F.sum(F.col("advantage") * F.col("value")).alias("score"))
    return G.scores_or_zero(r, scores).select("group_id", r6("score").alias("score"))


@query(f"{_COORDS}, m AS (SELECT idx, avg(x * x) AS second FROM coords GROUP BY 1) SELECT vec_id, round(sum(x / (sqrt(second) + 1e-8)), 6) + 0.0 AS total FROM coords JOIN m USING (idx) GROUP BY 1")
def optimizer_scaled(spark, sf_dir):
    c = S.coords(spark, sf_dir)
    moments = c.groupBy("idx").agg(F.avg(F.col("x") * F.col("x")).alias("second"))
    return G.optimizer_scaled(c, moments).groupBy("vec_id").agg(r6(F.sum("x")).alias("total"))


@query(f"{ROLL} SELECT group_id, round(sum(-logp * (reward - 0.5)) / count(*), 6) + 0.0 AS loss FROM rollouts GROUP BY 1")
def group_loss(spark, sf_dir):
    t = S.rollouts(spark, sf_dir).select("group_id", (-F.col("logp")).alias("ce"), (F.col("reward") - 0.5).alias("advantage"), F.lit(1).alias("n_tokens"))
    return G.group_loss(t).select("group_id", r6("loss").alias("loss"))


@query("SELECT vec_id FROM embeddings WHERE vec_id >= 150 AND vec_id < 200")
def machine_part(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").where(K.machine_part(F.col("vec_id"), 3, 50)).select("vec_id")


@query(f"{ROLL} SELECT count(*) AS pool, CAST(count(*) FILTER (value > 0.4) AS BIGINT) AS chosen, count(*) FILTER (pred = 'RF') AS rf, count(*) FILTER (pred = 'NO') AS no FROM rollouts")
def manifest_reasons(spark, sf_dir):
    r = S.rollouts(spark, sf_dir).select(F.col("value").alias("score"), (F.col("value") > 0.4).alias("selected"), "pred")
    count = lambda x: F.coalesce(F.try_element_at("reasons", F.lit(x)), F.lit(0))
    return T.manifest(r, F.col("pred")).select("pool", "chosen", count("RF").alias("rf"), count("NO").alias("no"))


@query(f"{ROLL} SELECT group_id, sample_id, round(CASE WHEN passed THEN ln(1 + exp(-(value - 0.3) * 2000)) WHEN value > 0.3 THEN (value - 0.3) * 2000 + ln(1 + exp(-(value - 0.3) * 2000)) ELSE ln(1 + exp((value - 0.3) * 2000)) END, 6) + 0.0 AS ce FROM rollouts WHERE NOT (passed AND value < 0.2)")
def reward_model_ce_large(spark, sf_dir):
    r = S.rollouts(spark, sf_dir).where("not (passed and value < 0.2)")
    return r.select("group_id", "sample_id", r6(L.reward_model_ce((F.col("value") - 0.3) * 2000, F.col("passed").cast("int"))).alias("ce"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS wrong FROM orders")
def countdown_reasons(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 1).cast("int").alias("a"))
    target = F.col("a") + 3 + (F.col("o_orderkey") % 2 == 0).cast("int")
    text = F.concat(F.lit("\\boxed{3+"), F.col("a").cast("string"), F.lit("}"))
    return o.select("o_orderkey", N.countdown_reason(text, F.array(F.lit(3), F.col("a")), target).isNotNull().alias("wrong"))
