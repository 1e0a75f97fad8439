"""Queries of scans over long sequences, exact resampling laws and independent draws."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.operators import advantage as A
from harrow.operators import block_svd as B
from harrow.operators import draws as D
from harrow.operators import metrics as M
from harrow.operators import votes as V
from harrow.plans import standins as S
from harrow.plans.registry import query, r6

ROLL = "WITH " + S.SQL["rollouts"]

# ---- one supplier's lines are one long sequence ----------------------------------------------------

_ORDER = ("l_orderkey", *S.LINE)
_LONG = f"""t AS (SELECT l_suppkey AS seq, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(_ORDER)}) - 1 AS pos, CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS r,
  l_extendedprice / 131072 AS v, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS m FROM lineitem), z AS (SELECT seq, max(pos) AS z FROM t GROUP BY 1)"""


def _long(spark, sf_dir):
    flag, line = F.col("l_returnflag"), S.table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*_ORDER)) - 1
    reward = F.when(flag == "R", 1.0).when(flag == "A", 0.5).otherwise(0.0)
    return line.select(F.col("l_suppkey").alias("seq"), pos.cast("long").alias("pos"), reward.alias("reward"), (F.col("l_extendedprice") / 131072).alias("value"), (F.col("l_quantity") > 10).cast("int").alias("mask"))


@query(f"""WITH RECURSIVE {_LONG}, scan AS (
  SELECT t.seq, pos, v, CASE WHEN m = 1 THEN v ELSE 0.0::DOUBLE END AS nxt, CASE WHEN m = 1 THEN r - v ELSE 0.0::DOUBLE END AS run FROM t JOIN z ON t.seq = z.seq AND pos = z
  UNION ALL SELECT t.seq, t.pos, t.v, CASE WHEN t.m = 1 THEN t.v ELSE s.nxt END, CASE WHEN t.m = 1 THEN t.r + 0.9 * s.nxt - t.v + 0.9 * 0.95 * s.run ELSE s.run END FROM scan s JOIN t ON t.seq = s.seq AND t.pos = s.pos - 1)
  SELECT seq, pos, round(run, 6) + 0.0 AS advantage, round(run + v, 6) + 0.0 AS return FROM scan""")
def gae_long(spark, sf_dir):
    got = A.gae_rows(_long(spark, sf_dir), seq="seq", pos="pos", chunk=64)
    return got.select("seq", "pos", r6("advantage").alias("advantage"), r6("return").alias("return"))


@query(f"""WITH RECURSIVE {_LONG}, scan AS (SELECT t.seq, pos, v AS got, v * m AS run FROM t JOIN z ON t.seq = z.seq AND pos = z
  UNION ALL SELECT t.seq, t.pos, t.v + 0.9 * s.run, (t.v + 0.9 * s.run) * t.m FROM scan s JOIN t ON t.seq = s.seq AND t.pos = s.pos - 1)
  SELECT seq, pos, round(got, 6) + 0.0 AS return FROM scan""")
def reinforce_long(spark, sf_dir):
    return A.reinforce_rows(_long(spark, sf_dir), seq="seq", pos="pos", reward="value", chunk=64).select("seq", "pos", r6("return").alias("return"))


@query(f"""WITH {_LONG} SELECT seq, pos, round(sum(r * m) OVER o, 6) + 0.0 AS return, round(sum(r * m) OVER o - 0.25 * m, 6) + 0.0 AS advantage
  FROM t WINDOW o AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def remax_long(spark, sf_dir):
    got = A.remax_rows(_long(spark, sf_dir), F.lit(0.25), seq="seq", pos="pos", chunk=64)
    return got.select("seq", "pos", r6("return").alias("return"), r6("advantage").alias("advantage"))


# ---- resampling: laws and draws --------------------------------------------------------------------


@query(f"""{ROLL}, p AS (SELECT benchmark, group_id, count(*) AS n, avg(reward) AS mean, stddev_pop(reward) AS std FROM rollouts GROUP BY ALL),
  c AS (SELECT benchmark, group_id, reward AS x, count(*) AS c FROM rollouts GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY benchmark, group_id) AS n, sum(c) OVER (PARTITION BY benchmark, group_id ORDER BY x) AS u FROM c),
  k AS (SELECT *, unnest(list_append([x FOR x IN [2, 4, 8, 16, 32] IF x < n], n)) AS k FROM s WHERE n > 1),
  w AS (SELECT *, (u / n) ** k - ((u - c) / n) ** k AS b, ((n - u + c) / n) ** k - ((n - u) / n) ** k AS w FROM k),
  e AS (SELECT benchmark, group_id, CAST(k AS VARCHAR) AS k, sum(x * b) AS bm, sqrt(greatest(sum(x * x * b) - sum(x * b) ** 2, 0)) AS bs, sum(x * w) AS wm, sqrt(greatest(sum(x * x * w) - sum(x * w) ** 2, 0)) AS ws FROM w GROUP BY ALL),
  l AS (SELECT benchmark, 'mean@' || n AS metric, mean AS x FROM p UNION ALL SELECT benchmark, 'std@' || n, std FROM p WHERE n > 1
    UNION ALL SELECT benchmark, 'best@' || k || '/mean', bm FROM e UNION ALL SELECT benchmark, 'best@' || k || '/std', bs FROM e
    UNION ALL SELECT benchmark, 'worst@' || k || '/mean', wm FROM e UNION ALL SELECT benchmark, 'worst@' || k || '/std', ws FROM e)
  SELECT benchmark AS source, 'reward' AS variable, metric, round(avg(x), 5) AS value FROM l GROUP BY ALL""")
def validation_table(spark, sf_dir):
    got = M.validation_table(S.rollouts(spark, sf_dir), values=("pred", "reward"))
    return got.withColumn("value", F.round("value", 5))


@query(f"""{ROLL}, r AS (SELECT group_id, sample_id, pred, reward FROM rollouts),
  d AS (SELECT a.group_id, CASE WHEN a.pred = b.pred OR a.pred = c.pred OR b.pred <> c.pred THEN a.reward ELSE b.reward END AS x FROM r a JOIN r b ON a.group_id = b.group_id JOIN r c ON a.group_id = c.group_id)
  SELECT group_id, round(avg(x), 6) AS majority, round(stddev_pop(x), 6) AS majority_std FROM d GROUP BY 1""")
def majority_exact(spark, sf_dir):
    """Of three draws: the first's vote wins if another agrees with it, or if all differ; else the second's."""
    got = V.majority(S.rollouts(spark, sf_dir), [3])
    return got.select("group_id", r6("majority").alias("majority"), r6("majority_std").alias("majority_std"))


@query()
def validation_votes(spark, sf_dir):
    """The table with majority votes, which no plain SQL counts for every k."""
    return M.validation_table(S.rollouts(spark, sf_dir), values=("reward", "value"), vote="pred")


@query("SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS copies, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) > 0 AS drawn FROM lineitem")
def independent_draws(spark, sf_dir):
    """All draws are dealt, none to rows without weight."""
    got = D.multinomial(S.rollouts(spark, sf_dir), ["group_id", "sample_id"], F.col("reward"), seed=3)
    return got.agg(F.count("*").alias("n"), F.sum(F.when(F.col("reward") > 0, F.col("copies")).otherwise(-F.col("copies"))).alias("copies"), F.bool_or(F.col("copies") > 0).alias("drawn"))


# ---- matrices in blocks: the vectors of a label are one matrix, in slices of 16 columns ------------


def _label_blocks(spark, sf_dir):
    rows = S.vectors(spark, sf_dir).select("label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("i"), "v")
    slices = rows.select(F.col("label").alias("id"), "i", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.slice("v", j * 16 + 1, F.lit(16)))).alias("j", "v"))
    return B.blocks(slices, j="j", size=32)


@query("SELECT label AS id, round(sqrt(sum(x * x)), 5) AS frobenius, round(sum(x * x), 4) AS energy FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def block_svd_energy(spark, sf_dir):
    """All 64 singular values: their squares sum up to the matrix's."""
    got = B.svd(_label_blocks(spark, sf_dir), 64, rounds=1)[0]
    return got.select("id", F.round("frobenius", 5).alias("frobenius"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x), 4).alias("energy"))


@query()
def block_svd(spark, sf_dir):
    """The leading four, by the range finder; checked against a dense factorization."""
    got = B.svd(_label_blocks(spark, sf_dir), 4)[0]
    return got.select("id", F.round("frobenius", 5).alias("frobenius"), F.transform("s", lambda x: F.round(x, 5)).alias("s"))


@query("""WITH e AS (SELECT vec_id, 0 AS j, unnest([abs(CAST(x AS DOUBLE)) FOR x IN embedding[1:16]]) AS x FROM embeddings UNION ALL SELECT vec_id, 1, unnest([abs(CAST(x AS DOUBLE)) FOR x IN embedding[17:32]]) FROM embeddings
    UNION ALL SELECT vec_id, 2, unnest([abs(CAST(x AS DOUBLE)) FOR x IN embedding[33:48]]) FROM embeddings UNION ALL SELECT vec_id, 3, unnest([abs(CAST(x AS DOUBLE)) FOR x IN embedding[49:64]]) FROM embeddings),
  n AS (SELECT vec_id, j, x / sum(x) OVER (PARTITION BY vec_id, j) AS p FROM e), r AS (SELECT vec_id, j, exp(-sum(p * ln(p)) FILTER (p > 0)) AS r FROM n GROUP BY ALL)
  SELECT vec_id AS group_id, 1 AS layers, round(sum(r), 5) AS score, round(sum(r) FILTER (j = 3), 5) AS o FROM r GROUP BY 1""")
def collective_scores(spark, sf_dir):
    """A vector's quarters as the spectra of a layer's four projections."""
    names = F.array(*(F.lit(f"model.layers.0.self_attn.{p}_proj.weight") for p in "qkvo"))
    v = S.vectors(spark, sf_dir).select(F.col("vec_id").alias("group_id"), F.posexplode(names).alias("j", "name"), F.transform("v", F.abs).alias("v"))
    rows = v.select("group_id", "name", F.slice("v", F.col("j") * 16 + 1, F.lit(16)).alias("s"))
    return B.collective_scores(rows).select("group_id", F.col("layers").cast("int").alias("layers"), F.round("score", 5).alias("score"), F.round("o", 5).alias("o"))
