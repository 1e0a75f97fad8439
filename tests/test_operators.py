"""Edge cases and properties that the oracles don't reach."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.operators import advantage as A
from harrow.operators import align as G
from harrow.operators import joins as J
from harrow.operators import losses as L
from harrow.operators import metrics as M
from harrow.operators import pack as U
from harrow.operators import select as T
from harrow.operators import shape as P
from harrow.operators import spectral as X


def rollouts(spark, groups):
    rows = [(g, i, float(r), 1) for g, rs in enumerate(groups) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "group_id long, sample_id long, reward double, length long")


def test_singletons_and_known_values(spark):
    df = rollouts(spark, [[1, 1, 0, 0], [3]])
    by = {n: {(r["group_id"], r["sample_id"]): r["advantage"] for r in A.estimator(n)(df).collect()} for n in ("grpo", "grpo_selection", "rloo", "rloo_vectorized", "pass_k")}
    assert by["grpo"][0, 0] == pytest.approx(0.5 / (0.5773502691896257 + 1e-6)) and by["grpo"][1, 0] == pytest.approx(3 / (1 + 1e-6))
    assert by["grpo_selection"][1, 0] == 0 and by["rloo"][1, 0] == 3 and by["rloo_vectorized"][1, 0] == 0
    assert by["pass_k"][0, 0] == 0 and by["pass_k"][1, 0] == 0
    assert [r["group_id"] for r in A.strict_groups(df).collect()] == [1]
    with pytest.raises(ValueError):
        A.register("grpo")(lambda df: df)
    with pytest.raises(KeyError):
        A.estimator("GRPO")


def test_rloo_equals_vectorized(spark):
    rng = random.Random(0)
    df = rollouts(spark, [[rng.random() for _ in range(rng.randint(2, 6))] for _ in range(40)])
    a = A.rloo(df).withColumnRenamed("advantage", "a").join(A.rloo_vectorized(df), ["group_id", "sample_id"])
    assert a.where(F.abs(F.col("a") - F.col("advantage")) > 1e-9).isEmpty()


def test_gae_golden(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0], [0.5, 0.4, 0.3], [1, 1, 1]), ([], [], [])], "reward array<double>, value array<double>, mask array<int>")
    got = [r["advantages"] for r in A.gae(df).collect()]
    assert got[0] == pytest.approx([0.2605675, 0.4685, 0.7]) and got[1] == []


def test_group_mean_std(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "group_id long, reward double")
    got = {r["group_id"]: (r["mean"], r["count"], r["std"]) for r in M.group_mean_std(df, "group_id", "reward").collect()}
    assert got[0] == pytest.approx((2.0, 2, 2**0.5)) and got[1] == (0.0, 1, 1.0)


def test_majority_tie_is_first_seen(spark):
    df = spark.createDataFrame([(0, 0, "A", 0.9), (0, 1, "B", 0.8), (0, 2, "B", 0.7), (0, 3, "A", 0.6)], "group_id long, sample_id long, pred string, score double")
    assert M.majority(df, "score").first()["score"] == 0.9


def test_spectra(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 0.0],), ([2.0, 0.0],)], "s array<double>")
    assert [r[0] for r in df.select(X.effective_rank(F.col("s"))).collect()] == pytest.approx([2.0, 0.0, 1.0])
    with pytest.raises(Exception, match="negative or infinite"):
        spark.createDataFrame([([-1.0, 1.0],)], "s array<double>").select(X.effective_rank(F.col("s"))).collect()
    m = spark.createDataFrame([(1, 0, [[3.0, 0.0], [0.0, 1.0]]), (2, 0, [[0.0, 0.0], [0.0, 0.0]])], "id long, k long, matrix array<array<double>>")
    assert [r["s"] for r in X.truncated_svd(m, 2).orderBy("id").collect()] == [pytest.approx([3.0, 1.0]), pytest.approx([0.0, 0.0])]
    own = X.subspace_overlap(m, m.where("id = 1"), 1, "k").orderBy("id").collect()
    assert [r["phi_u"] for r in own] == pytest.approx([1.0, 0.0])
    layers = spark.createDataFrame([("model.layers.3.self_attn.q_proj.weight",), ("lm_head.weight",)], "n string").select(*(c.alias(k) for k, c in X.classify(F.col("n")).items())).collect()
    assert tuple(layers[0]) == (3, "Q") and tuple(layers[1]) == (None, None)


def test_selection_errors_and_ranks(spark):
    df = spark.createDataFrame([(i, float(-i % 7), i % 2 == 0) for i in range(50)], "group_id long, score double, eligible boolean")
    ranks = [r["rank"] for r in T.ranked(df, [F.desc("score"), F.asc("group_id")]).orderBy(F.desc("score"), "group_id").collect()]
    assert ranks == list(range(1, 51))
    assert T.top_half(df).count() == 25
    with pytest.raises(ValueError):
        T.top_half(df.limit(49))
    with pytest.raises(ValueError):
        T.random_pick(df, 51, 1, "group_id", strict=True)
    assert T.refill(df, F.lit(False), ["group_id"]).count() == 0
    assert T.chunks(df, 60, 1, "group_id").where("chunk = 0").count() == 50


def test_module_names_and_modes(spark):
    names = spark.createDataFrame([("a.b.weight",), ("module.a.b.weight",), ("x",)], "n string").select(G.module_of(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a.b", "a.b", "x"]
    with pytest.raises(ValueError):
        G.adamw_counterfactual(names and spark.range(1), 1, 0.1, amsgrad=True)


def test_batch_shapes(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "i long, x string")
    at = lambda d: "".join(r["x"] for r in d.orderBy("at").collect())
    assert at(P.repeat(df, 2, "i")) == "aabbcc" and at(P.repeat(df, 2, "i", 3, interleave=False)) == "abcabc"
    assert [at(P.pad_to(df, d, "i")) for d in (2, 3, 7)] == ["abca", "abc", "abcabca"]
    assert P.unpad(P.pad_to(df, 7, "i")).count() == 3
    with pytest.raises(ValueError):
        P.chunk_of("i", 2, 3)
    seq = spark.createDataFrame([([10, 11], [20, 21, 22, 23])], "p array<int>, r array<int>").select(*(c.alias(k) for k, c in P.assemble(F.col("p"), F.col("r"), 5).items())).first()
    assert (seq["input_ids"], seq["response_mask"], seq["was_truncated"]) == ([10, 11, 20, 21, 22], [0, 1, 1, 1], True)
    mask = spark.createDataFrame([([1, 5, 2, 5],), ([1, 2],)], "t array<int>").select(A.response_mask(F.col("t"), 5)).collect()
    assert [r[0] for r in mask] == [[1, 1, 0, 0], [1, 1]]


def test_union_conflict(spark):
    a = spark.createDataFrame([(0, 1.0, float("nan")), (1, 2.0, 1.0)], "i long, x double, y double")
    assert set(J.column_union(a, a.select("i", "y", F.lit(3).alias("z")), "i").columns) == {"i", "x", "y", "z"}
    assert J.column_union(a, a.select("i", "y"), "i").count() == 2
    with pytest.raises(Exception, match="differ"):
        J.column_union(a, a.select("i", (F.col("x") + 1).alias("x")), "i").collect()


@given(st.lists(st.integers(1, 100), min_size=1, max_size=24), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_packing(costs, k):
    for shard in (U.greedy(costs, k, sorted(range(len(costs)), key=lambda i: -costs[i])), U.differencing(costs, k, False)):
        loads = [sum(c for c, s in zip(costs, shard, strict=True) if s == b) for b in range(k)]
        assert max(loads) - min(loads) <= max(costs)
    if len(costs) % k == 0:
        shard = U.differencing(costs, k, True)
        assert {shard.count(b) for b in range(k)} == {len(costs) // k}


def test_small_packing_is_best():
    for costs in ([4, 5, 6, 7, 8], [1, 1, 1, 9]):
        best = min(max(sum(c for c, s in zip(costs, p, strict=True) if s == b) for b in range(2)) for p in itertools.product(range(2), repeat=len(costs)))
        shard = U.differencing(costs, 2, False)
        assert max(sum(c for c, s in zip(costs, shard, strict=True) if s == b) for b in range(2)) <= best * 1.1


def test_kl_cov_of_many_tokens(spark):
    n = 1_000_100
    tokens = spark.range(n).select("id", F.col("id").cast("double").alias("advantage"), (-F.col("id") / n).alias("logp"), (1 - F.col("id") / n).alias("old_logp"), F.lit(1).alias("mask"))
    got = L.kl_cov(tokens, ["id"], share=1.0, beta=1e9)
    assert got.where("loss > 5e8").count() == n
