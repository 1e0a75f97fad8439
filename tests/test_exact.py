"""Scans, exact laws, draws and searches against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import advantage as A
from harrow.operators import draws, losses, metrics, scan, search, select, votes


def steps(a, b):
    out, x = [], 0.0
    for p, q in zip(reversed(a), reversed(b), strict=True):
        out.append((p * x + q, x))
        x = p * x + q
    return out[::-1]


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_scan(spark, chunk):
    rng = random.Random(chunk)
    seqs = {s: [(rng.choice([0.0, 1.0, 0.9, -0.5]), rng.random()) for _ in range(n)] for s, n in enumerate([1, 2, 30, 7, 64])}
    seqs[None] = [(0.5, 1.0)] * 5
    rows = [(s, i, a, b) for s, v in seqs.items() for i, (a, b) in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s long, i long, a double, b double")
    got = {(r["s"], r["i"]): (r["x"], r["y"]) for r in scan.affine_scan(df, "s", "i", F.col("a"), F.col("b"), "x", "y", chunk=chunk).collect()}
    want = {(s, i): xy for s, v in seqs.items() for i, xy in enumerate(steps([a for a, _ in v], [b for _, b in v]))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert scan.affine_scan(df.limit(0), "s", "i", F.col("a"), F.col("b"), "x").collect() == []


@pytest.mark.parametrize("chunk", [3, 4096])
def test_rows_and_arrays_agree(spark, chunk):
    rng = random.Random(1)
    seqs = [(g, [float(rng.random()) for _ in range(n)], [float(rng.random()) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]) for g, n in enumerate([0, 1, 5, 20])]
    arrays = spark.createDataFrame(seqs, "group_id long, reward array<double>, value array<double>, mask array<int>")
    rows = arrays.select("group_id", F.posexplode(F.arrays_zip("reward", "value", "mask")).alias("sample_id", "z")).select("group_id", F.col("sample_id").cast("long").alias("sample_id"), "z.*")
    for one, many, cols in ((A.gae, A.gae_rows, ("advantage", "return")), (A.reinforce_returns, A.reinforce_rows, ("return",)), (lambda d: A.remax(d, F.lit(0.5)), lambda d, chunk: A.remax_rows(d, F.lit(0.5), chunk=chunk), ("advantage", "return"))):
        want = {(r["group_id"], i): x for r in one(arrays).collect() for i, x in enumerate(zip(*(r[c + "s"] for c in cols), strict=True))}
        got = {(r["group_id"], r["sample_id"]): tuple(r[c] for c in cols) for r in many(rows, chunk=chunk).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def law(sample, k):
    """Mean and deviation over all k-tuples of (vote, value)."""
    xs = []
    for t in itertools.product(sample, repeat=k):
        seen = Counter(v for v, _ in t)
        won = max(seen, key=seen.get)
        xs.append(next(x for v, x in t if v == won))
    return np.mean(xs), np.std(xs)


@pytest.mark.parametrize("counts", [(1,), (3, 1), (2, 2, 1), (1, 1, 1, 1), (4, 1, 1)])
@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_chances(counts, k):
    want = np.zeros(len(counts))
    for t in itertools.product(range(len(counts)), repeat=k):
        seen = Counter(t)
        want[max(seen, key=seen.get)] += math.prod(counts[c] / sum(counts) for c in t)
    assert votes.win_chances(counts, k) == pytest.approx(tuple(want))


def test_chances_of_many():
    got = votes.win_chances((40, 30, 20, 10, *[1] * 28), 128)
    assert sum(got) == pytest.approx(1, abs=1e-12) and got[0] > got[1] > got[2] > got[3] > got[4] == pytest.approx(got[-1], abs=1e-15)


def test_majority_and_table(spark):
    rng = random.Random(2)
    groups = {g: [(rng.choice(["a", "b", None]), round(rng.random(), 2)) for _ in range(n)] for g, n in enumerate([1, 2, 3, 5, 5])}
    df = spark.createDataFrame([(g, "s", v, x) for g, s in groups.items() for v, x in s], "group_id long, benchmark string, pred string, reward double")
    got = {(r["group_id"], r["k"]): (r["majority"], r["majority_std"]) for r in votes.majority(df).collect()}
    want = {(g, k): law(s, k) for g, s in groups.items() for k in votes.sizes(len(s))}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    table = {r["metric"]: r["value"] for r in metrics.validation_table(df, values=("pred", "reward"), vote="pred").collect()}
    assert table["maj@2/mean"] == pytest.approx(np.mean([want[g, 2][0] for g in range(1, 5)]))
    assert table["maj@5/std"] == pytest.approx(np.mean([want[g, 5][1] for g in (3, 4)]))
    best = [[max(t) for t in itertools.product([x for _, x in groups[g]], repeat=4)] for g in (3, 4)]
    assert table["best@4/mean"] == pytest.approx(np.mean([np.mean(b) for b in best])) and table["best@4/std"] == pytest.approx(np.mean([np.std(b) for b in best]))
    worst = [[min(t) for t in itertools.product([x for _, x in groups[g]], repeat=3)] for g in (2,)]
    assert table["worst@3/std"] == pytest.approx(np.std(worst[0])) and table["mean@1"] == groups[0][0][1] and "std@1" not in table
    with pytest.raises(ValueError, match="number"):
        metrics.validation_table(df, values=("pred",))


def test_dealt_is_multinomial():
    """Means, variances and covariances of independent draws; systematic points would have almost no variance."""
    w = np.array([0.5, 3.0, 0.0, 1.5, 2.0])
    p, n, trials = w / w.sum(), 40, 20000
    rng = np.random.default_rng(5)
    got = np.array([draws.dealt(n, w, rng) for _ in range(trials)])
    assert (got.sum(axis=1) == n).all() and not got[:, 2].any()
    assert np.abs(got.mean(axis=0) - n * p).max() < 0.1
    assert np.abs(np.cov(got.T) - n * (np.diag(p) - np.outer(p, p))).max() < 0.4


@pytest.mark.parametrize("how", [{}, {"bits": 2, "leaf": 4}])
def test_multinomial(spark, how):
    df = spark.createDataFrame([(i, float(i % 4), "clash") for i in range(200)], "i long, w double, node string")
    runs = [[r["copies"] for r in draws.multinomial(df, ["i"], F.col("w"), draws=1000, seed=s, **how).orderBy("i").collect()] for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2] and [sum(r) for r in runs] == [1000] * 3
    assert all(not c for c in runs[0][::4])
    share = [sum(runs[0][k::4]) / 1000 for k in (1, 2, 3)]
    assert np.abs(np.array(share) - np.array([1, 2, 3]) / 6).max() < 0.08
    assert draws.multinomial(df.limit(0), ["i"], F.col("w")).collect() == []


def test_weights_of_resampling(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "i long, reward double")
    by = lambda mode: {r["reward"]: r["n"] for r in losses.resample(df, ["i"], mode=mode).groupBy("reward").agg(F.sum("copies").alias("n")).collect()}
    got = by("max_min")
    assert got[1.0] == 0 and abs(got[0.0] - 150) < 45
    got = by("max_random")
    assert abs(got[2.0] - 200) < 45 and abs(got[0.0] - 50) < 35
    with pytest.raises(ValueError, match="weights"):
        losses.resample(df, ["i"], mode="other")


@pytest.mark.parametrize("how", [{}, {"query_block": 3, "most": 200}])
def test_nearest(spark, how):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (90, 6)).astype(float)
    v[40:45] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (500, None)], "id long, v array<double>")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in search.nearest(df.where("id % 7 = 0 or id is null"), df, 4, **how).collect()}
    want = {}
    for q in range(0, 90, 7):
        best = sorted((-float(v[q] @ v[i]), i) for i in range(90))[:4]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("how", [{}, {"docs": 2, "first": 1}])
def test_bm25(spark, how):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["the"] * 60
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for i in range(80)} | {200: "", 201: None}
    asked = {1: "the W3 w5 w5 w7", 2: "the", 3: "nothing here", 4: None}
    split = {i: (t or "").lower().split() for i, t in texts.items()}
    full = {i: w for i, w in split.items() if w}
    avg, n = sum(map(len, full.values())) / len(full), len(full)
    df = Counter(t for w in full.values() for t in set(w))
    want = {}
    for q, t in asked.items():
        s = {i: sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 1.9 / (w.count(x) + 0.9 * (0.6 + 0.4 * len(w) / avg)) for x in set((t or "").lower().split()) if x in w) for i, w in full.items() if set(w) & set((t or "").lower().split())}
        want |= {(q, r + 1): (i, pytest.approx(x)) for r, (i, x) in enumerate(sorted(s.items(), key=lambda y: (-round(y[1], 9), y[0]))[:5])}
    frames = [spark.createDataFrame(list(x.items()), "id long, text string") for x in (asked, texts)]
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in search.bm25(*frames, 5, **how).collect()}
    assert got == want


def test_top_of_a_share(spark, monkeypatch):
    df = spark.createDataFrame([(i, i * 7 % 50) for i in range(50)], "id long, x long")
    small = {r["id"] for r in select.top(df, 20, [F.desc("x"), F.asc("id")]).collect()}
    monkeypatch.setattr(select, "MOST_HEAP", 5)
    big = select.top(df, 20, [F.desc("x"), F.asc("id")])
    assert {r["id"] for r in big.collect()} == small and big.columns == df.columns


def test_whiten_keeps_digits(spark):
    df = spark.createDataFrame([(1e7 + x,) for x in (0.0, 1.0, 2.0)], "x double")
    got = sorted(r["x"] for r in A.whiten(df, "x", F.lit(1)).collect())
    assert got[2] - got[0] == pytest.approx(2.0, rel=2e-3)


def test_table_computes_each_law_once(spark):
    """A branch for the mean and one for the deviation had a Python call each; prompts of one value have none."""
    df = spark.createDataFrame([("b", g, p, float(r)) for g, p, r in ((1, "x", 1), (1, "y", 0), (1, "x", 1), (2, "x", 1))], "benchmark string, group_id long, pred string, reward double")
    got = metrics.validation_table(df, vote="pred")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Window") <= 2
    table = {r["metric"]: r["value"] for r in got.collect()}
    assert table["mean@1"] == 1.0 and table["mean@3"] == pytest.approx(2 / 3) and "std@1" not in table
    assert table["maj@3/mean"] == pytest.approx(20 / 27) and table["best@2/mean"] == pytest.approx(8 / 9)
    sizes = spark.range(1, 300).select("id", metrics.subset_sizes(F.col("id")).alias("k")).collect()
    assert all(r.k == votes.sizes(r.id) for r in sizes)
    assert spark.range(1).select(metrics.subset_sizes(F.lit((1 << 33) + 1)).alias("k")).first().k == [*(1 << i for i in range(1, 31)), (1 << 33) + 1]
