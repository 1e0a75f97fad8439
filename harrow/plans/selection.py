"""Queries of alignment, spectra and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import align as G
from harrow.operators import metrics as M
from harrow.operators import select as T
from harrow.operators import spectral as X
from harrow.plans import standins as S
from harrow.plans.registry import query, r6

COORDS = f"WITH {S.SQL['coords']}"
ROLL = f"WITH {S.SQL['rollouts']}"


def _cand(spark, sf_dir):
    return S.coords(spark, sf_dir).where("label <> 0").withColumnRenamed("vec_id", "id").withColumn("module", F.floor(F.col("idx") / 16))


def _val(spark, sf_dir, per_group=True):
    return G.validation_vector(S.coords(spark, sf_dir).where("label = 0").withColumnRenamed("vec_id", "id"), per_group)


_VAL = """, nv AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-5 AS n FROM coords GROUP BY 1),
  s AS (SELECT idx, sum(x / n) AS v FROM coords JOIN nv USING (vec_id) WHERE label = 0 GROUP BY 1),
  val AS (SELECT idx, v / (SELECT sqrt(sum(v * v)) + 1e-5 FROM s) AS v FROM s)"""
_SIM = f"{COORDS}{_VAL}, sim AS (SELECT vec_id AS group_id, sum(x * v) / max(n) AS score FROM coords JOIN val USING (idx) JOIN nv USING (vec_id) WHERE label <> 0 GROUP BY 1)"


@query(f"{_SIM} SELECT group_id AS id, round(score, 6) + 0.0 AS score FROM sim")
def cosine_similarity(spark, sf_dir):
    return G.scores(_cand(spark, sf_dir), _val(spark, sf_dir)).select("id", r6("score").alias("score"))


@query(f"""{COORDS}, s AS (SELECT idx, sum(x) AS v FROM coords WHERE label = 0 GROUP BY 1), val AS (SELECT idx, v / (SELECT sqrt(sum(v * v)) + 1e-5 FROM s) AS v FROM s)
  SELECT vec_id AS id, round(sum(x * v), 6) + 0.0 AS score FROM coords JOIN val USING (idx) WHERE label <> 0 GROUP BY 1""")
def dot_similarity(spark, sf_dir):
    return G.scores(_cand(spark, sf_dir), _val(spark, sf_dir, False), "dot").select("id", r6("score").alias("score"))


@query(f"{COORDS} SELECT vec_id AS id, round(sqrt(sum(x * x)) + 1e-5, 6) AS score FROM coords WHERE label <> 0 GROUP BY 1")
def grad_norm(spark, sf_dir):
    return G.scores(_cand(spark, sf_dir), _val(spark, sf_dir), "norm").select("id", r6("score").alias("score"))


@query(f"""{COORDS}, nv AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-5 AS n FROM coords GROUP BY 1), s AS (SELECT idx, sum(x / n) AS v FROM coords JOIN nv USING (vec_id) WHERE label <> 0 GROUP BY 1),
  val AS (SELECT idx, v / (SELECT sqrt(sum(v * v)) + 1e-5 FROM s) AS v FROM s)
  SELECT vec_id AS id, round(sum(x * v) / max(n), 6) + 0.0 AS score FROM coords JOIN val USING (idx) JOIN nv USING (vec_id) WHERE label <> 0 GROUP BY 1""")
def self_align(spark, sf_dir):
    own = _cand(spark, sf_dir)
    return G.scores(own, G.validation_vector(own, True)).select("id", r6("score").alias("score"))


_DOTS = f"{COORDS}{_VAL}, d AS (SELECT vec_id AS id, idx // 16 AS module, sum(x * v / n) AS dot FROM coords JOIN val USING (idx) JOIN nv USING (vec_id) WHERE label <> 0 GROUP BY 1, 2)"


@query(f"{_DOTS} SELECT id, CAST(module AS BIGINT) AS module, round(dot, 6) + 0.0 AS dot FROM d")
def per_module_dot(spark, sf_dir):
    return G.module_scores(_cand(spark, sf_dir), _val(spark, sf_dir)).select("id", "module", r6("dot").alias("dot"))


@query(f"{_DOTS} SELECT id, CAST(module AS BIGINT) AS module, round(dot, 6) + 0.0 AS dot, CAST(k AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(dot) DESC, module) AS k FROM d) WHERE k <= 2")
def top_modules(spark, sf_dir):
    got = G.top_modules(G.module_scores(_cand(spark, sf_dir), _val(spark, sf_dir)), 2)
    return got.select("id", "module", r6("dot").alias("dot"), F.col("rank").cast("long").alias("rank"))


def _sims(spark, sf_dir):
    return G.scores(_cand(spark, sf_dir), _val(spark, sf_dir)).withColumnRenamed("id", "group_id")


@query(f"{_SIM} SELECT group_id FROM sim ORDER BY score DESC, group_id LIMIT 100")
def topn_sim(spark, sf_dir):
    return T.top_scores(_sims(spark, sf_dir), 100)


@query(f"{_SIM} SELECT group_id FROM sim ORDER BY score, group_id LIMIT 100")
def topn_negsim(spark, sf_dir):
    return T.top_scores(_sims(spark, sf_dir), 100, descending=False)


_RANK = f"{_SIM}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, group_id) AS rank FROM sim)"


@query(f"{_RANK} SELECT group_id, round(score, 6) + 0.0 AS score, rank, rank <= 200 AS selected FROM r")
def topn_rank_list(spark, sf_dir):
    return T.rank_list(_sims(spark, sf_dir), 200).select("group_id", r6("score").alias("score"), "rank", "selected")


@query(f"{_RANK} SELECT group_id, rank FROM r WHERE rank BETWEEN 191 AND 200")
def boundary_report(spark, sf_dir):
    return T.cut_report(T.rank_list(_sims(spark, sf_dir), 200), 200).select("group_id", "rank")


@query(f"""{_RANK} SELECT count(*) AS pool, count(*) FILTER (rank <= 200) AS chosen, round(avg((rank <= 200)::INT), 6) AS share, round(min(score) FILTER (rank <= 200), 6) AS cutoff, round(min(score), 6) AS least, round(max(score), 6) AS most FROM r""")
def selection_manifest(spark, sf_dir):
    m = T.manifest(T.rank_list(_sims(spark, sf_dir), 200))
    return m.select("pool", "chosen", *(r6(c).alias(c) for c in ("share", "cutoff", "least", "most")))


_ACC = f"{_SIM}, {S.SQL['rollouts']}, acc AS (SELECT group_id, avg(passed::INT) AS accuracy FROM rollouts GROUP BY 1)"


def _acc(spark, sf_dir):
    return M.accuracy_by_group(S.rollouts(spark, sf_dir))


@query(f"{_ACC} SELECT group_id, round(score * 4 * accuracy * (1 - accuracy), 6) + 0.0 AS score FROM sim JOIN acc USING (group_id)")
def simacc(spark, sf_dir):
    return T.uncertainty_weighted(_sims(spark, sf_dir), _acc(spark, sf_dir)).select("group_id", r6("score").alias("score"))


@query(f"{ROLL}, acc AS (SELECT group_id, avg(passed::INT) AS accuracy FROM rollouts GROUP BY 1) SELECT group_id, round(accuracy, 6) AS accuracy FROM acc ORDER BY abs(accuracy - 0.5), group_id LIMIT 200")
def accgreedy(spark, sf_dir):
    return T.closest_to_half(_acc(spark, sf_dir), 200).select("group_id", r6("accuracy").alias("accuracy"))


@query(f"{ROLL}, acc AS (SELECT group_id, avg(passed::INT) AS accuracy FROM rollouts GROUP BY 1) SELECT group_id, round(accuracy, 6) AS accuracy FROM acc WHERE accuracy BETWEEN 0.125 AND 0.875 AND group_id < 1000 ORDER BY md5('7-' || group_id), group_id LIMIT 100")
def acc_band(spark, sf_dir):
    return T.accuracy_band(_acc(spark, sf_dir), 0.125, 0.875, 100, 7, 1000).select("group_id", r6("accuracy").alias("accuracy"))


@query("SELECT doc_id FROM documents ORDER BY md5('3-' || doc_id), doc_id LIMIT 50")
def seeded_random(spark, sf_dir):
    return T.random_pick(S.table(spark, sf_dir, "documents"), 50, 3, "doc_id").select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('5-' || doc_id), doc_id) - 1 AS index FROM documents WHERE lang IN ('en', 'de')")
def mixing(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return T.mix([d.where("lang = 'en'"), d.where("lang = 'de'")], 5, "doc_id").select("doc_id", "index")


@query("SELECT doc_id, CAST((k - 1) // 64 AS BIGINT) AS chunk FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('9-' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE (k - 1) // 64 < n // 64")
def chunking(spark, sf_dir):
    return T.chunks(S.table(spark, sf_dir, "documents").select("doc_id"), 64, 9, "doc_id")


@query("SELECT doc_id, CASE WHEN k <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('4-' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)")
def train_test_split(spark, sf_dir):
    return T.split(S.table(spark, sf_dir, "documents").select("doc_id"), 0.75, 4, "doc_id")


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at, count(*) OVER () AS m FROM documents WHERE n_chars <= 1500),
  n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, i AS index FROM n, LATERAL (SELECT unnest(range(n)) AS i) JOIN k ON k.at = i % k.m""")
def refill_filter(spark, sf_dir):
    return T.refill(S.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars") <= 1500, ["doc_id"]).select("doc_id", "index")


@query(f"{ROLL} SELECT group_id, sample_id FROM (SELECT *, stddev_pop(reward) OVER g AS d, count(*) OVER g AS n FROM rollouts WINDOW g AS (PARTITION BY group_id)) WHERE d > 0 OR n = 1")
def dynamic_group_filter(spark, sf_dir):
    return T.varied_groups(S.rollouts(spark, sf_dir)).select("group_id", "sample_id")


@query(f"""{ROLL}, a AS (SELECT *, avg(passed::INT) OVER (PARTITION BY group_id) BETWEEN 0.2 AND 0.8 AS ok FROM rollouts)
  SELECT group_id, sample_id FROM (SELECT *, row_number() OVER (ORDER BY ok DESC, group_id, sample_id) AS k, count(*) OVER () AS n FROM a) WHERE k <= floor(n * 0.5)""")
def prime_filter_downsample(spark, sf_dir):
    return T.bounded_accuracy(S.rollouts(spark, sf_dir), 0.2, 0.8, 0.5).select("group_id", "sample_id")


# ---- spectra: absolute embedding values as singular values ----------------------------------------

_SPEC = "WITH s AS (SELECT vec_id AS id, list_reverse_sort([abs(CAST(x AS DOUBLE)) FOR x IN embedding]) AS s FROM embeddings)"


def _spectra(spark, sf_dir):
    return S.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.sort_array(F.transform("v", F.abs), asc=False).alias("s"))


@query(f"{_SPEC} SELECT id, round(exp(-list_sum([x / list_sum(s) * ln(x / list_sum(s)) FOR x IN s IF x > 0])), 6) AS effective_rank FROM s")
def effective_rank(spark, sf_dir):
    return _spectra(spark, sf_dir).select("id", r6(X.effective_rank(F.col("s"))).alias("effective_rank"))


@query(f"""{_SPEC}, t AS (SELECT id, s[:16] AS k, sqrt(list_sum([x * x FOR x IN s])) AS f FROM s)
  SELECT id, round(list_sum(k), 6) AS total, round(k[1], 6) AS spectral_norm, round(f, 6) AS frobenius_norm, round(f * f / (k[1] * k[1]), 6) AS stable_rank, round(least(1, list_sum([x * x FOR x IN k]) / (f * f)), 6) AS energy_ratio FROM t""")
def spectrum_summary(spark, sf_dir):
    s = _spectra(spark, sf_dir).withColumn("f", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)))
    parts = X.summary(F.slice("s", 1, 16), F.col("f"))
    return s.select("id", *(r6(v).alias(k) for k, v in parts.items()))


def _matrices(spark, sf_dir):
    """Coordinates as one value per layer and family: idx = 7 layer + family."""
    family = F.element_at(F.array(*map(F.lit, X.FAMILIES.values())), (F.col("idx") % 7 + 1).cast("int"))
    return S.coords(spark, sf_dir).where("idx < 63").select(F.col("vec_id").alias("id"), F.floor(F.col("idx") / 7).alias("layer"), family.alias("family"), F.abs("x").alias("total"), F.abs("x").alias("phi_u"), (F.abs("x") / 2).alias("phi_v"))


@query(f"""{COORDS}, m AS (SELECT vec_id AS id, idx % 7 AS f, abs(x) AS t FROM coords WHERE idx < 63)
  SELECT id, round(sum(t) FILTER (f < 4), 6) AS qkvo, round(sum(t) FILTER (f >= 4), 6) AS mlp, round(sum(t), 6) AS "all" FROM m GROUP BY 1""")
def family_scores(spark, sf_dir):
    return X.scope_scores(_matrices(spark, sf_dir)).select("id", *(r6(c).alias(c) for c in X.SCOPES))


@query(f"""{COORDS}, m AS (SELECT vec_id AS id, idx % 7 AS f, abs(x) * 0.75 AS t FROM coords WHERE idx < 63)
  SELECT id, round(avg(t) FILTER (f < 4), 6) AS qkvo, round(avg(t) FILTER (f >= 4), 6) AS mlp, round(avg(t), 6) AS "all" FROM m GROUP BY 1""")
def subspace_scores(spark, sf_dir):
    return X.subspace_scores(_matrices(spark, sf_dir)).select("id", *(r6(c).alias(c) for c in X.SCOPES))


@query(f"{COORDS} SELECT vec_id AS id, 'DOWN' AS family, 'missing layer' AS error FROM coords WHERE idx = 62 AND x > 0")
def coverage_errors(spark, sf_dir):
    m = S.coords(spark, sf_dir).select("vec_id", "idx", "x").where("idx = 62 and x > 0").select(F.col("vec_id").alias("id"), F.lit(8).alias("layer"), F.lit("DOWN").alias("family"))
    return X.coverage_errors(_matrices(spark, sf_dir).select("id", "layer", "family").exceptAll(m.select("id", F.col("layer").cast("long"), "family")))


@query(f"""{COORDS}, w AS (SELECT vec_id AS id, idx, x AS g, 0.1 * x AS m, 0.01 * x * x AS v, x / 2 AS p FROM coords),
  d AS (SELECT *, -0.001 / (1 - 0.9 ** 5) * (0.9 * m + 0.1 * g) / (sqrt(0.999 * v + 0.001 * g * g) / sqrt(1 - 0.999 ** 5) + 1e-8) AS a, -0.001 / (1 - 0.9 ** 5) * (0.9 * m) / (sqrt(0.999 * v) / sqrt(1 - 0.999 ** 5) + 1e-8) AS z FROM w)
  SELECT id, round(sqrt(sum(a * a)), 6) AS actual, round(sqrt(sum((a - z) * (a - z))), 6) AS marginal, round(sqrt(sum((a - 0.00001 * p) * (a - 0.00001 * p))), 6) AS "full" FROM d GROUP BY 1""")
def adamw_delta(spark, sf_dir):
    x = F.col("x")
    rows = S.coords(spark, sf_dir).select(F.col("vec_id").alias("id"), x.alias("grad"), (0.1 * x).alias("m"), (0.01 * x * x).alias("v"), (x / 2).alias("param"))
    got = G.adamw_counterfactual(rows, 5, 0.001)
    return got.groupBy("id").agg(*(r6(F.sqrt(F.sum(F.col(c) * F.col(c)))).alias(c) for c in ("actual", "marginal", "full")))


@query(f"{COORDS} SELECT round(sqrt(sum(x * x)), 5) AS norm, round(least(1, 1.0 / (sqrt(sum(x * x)) + 1e-6)), 8) AS coefficient FROM coords")
def clip_coefficient(spark, sf_dir):
    return G.clip_coefficient(S.coords(spark, sf_dir)).select(F.round("norm", 5).alias("norm"), F.round("coefficient", 8).alias("coefficient"))


@query(f"""{COORDS}, q AS (SELECT vec_id, CASE WHEN label = 3 THEN 'zero_advantage' WHEN max(abs(x)) < 0.25 THEN 'zero_marginal_delta' END AS reason FROM coords GROUP BY vec_id, label) SELECT vec_id AS id, reason FROM q""")
def eligibility(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("id"), X.eligibility(F.col("label") == 3, F.array_max(F.transform("v", F.abs)) < 0.25).alias("reason"))


@query(f"""{_SPEC} SELECT id, CASE WHEN id % 3 = 0 THEN 'the sum is not that of the singular values' ELSE '' END AS errors FROM s""")
def record_errors(spark, sf_dir):
    s = _spectra(spark, sf_dir).withColumn("f", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) + F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0)
    return s.select("id", F.array_join(X.record_errors(F.col("s"), F.lit(64), total, X.effective_rank(F.col("s")), F.col("s")[0], F.col("f")), "; ").alias("errors"))


def _square(spark, sf_dir):
    """Embeddings as 8 x 8 matrices."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))
    return S.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", rows.alias("matrix"))


@query()
def truncated_svd(spark, sf_dir):
    got = X.truncated_svd(_square(spark, sf_dir), 4)
    return got.select("id", r6("frobenius").alias("frobenius"), F.transform("s", lambda x: F.round(x, 5)).alias("s"))


@query()
def subspace_overlap(spark, sf_dir):
    m = _square(spark, sf_dir)
    ref = m.groupBy("label").agg(F.min_by("matrix", "id").alias("matrix"))
    got = X.subspace_overlap(m, ref, 3, "label")
    return got.select("id", "label", F.round("phi_u", 5).alias("phi_u"), F.round("phi_v", 5).alias("phi_v"))
