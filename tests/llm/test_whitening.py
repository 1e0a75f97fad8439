"""Whitening against a dense eigendecomposition, and its iteration on hard spectra."""

import math

import numpy as np
import pytest

from harrow.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string"


def vectors(rows):
    return np.array([v for _, v, *_ in rows if v and None not in v and all(map(math.isfinite, v))])


def check(rows, got, k=8):
    x = np.floor(1024 * vectors(rows)).astype(np.int64) + 100_000
    n, d = x.shape
    k = min(k, d)
    s = x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert len(got) == n * k
    deviation = sorted(int(y) for y in ((n * x - s) ** 2).sum(axis=1) for _ in range(k))
    assert sorted(r["deviation"] for r in got) == deviation
    want = c @ u / np.sqrt(e)
    for j in range(k):
        own = np.sort([r["whitened"] for r in got if r["component"] == j + 1])
        assert min(np.abs(own - np.sort(want[:, j])).max(), np.abs(own - np.sort(-want[:, j])).max()) < 1e-7
        assert all(math.isclose(r["explained"], e[j] / np.trace(v), rel_tol=1e-10) for r in got if r["component"] == j + 1)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = whitening.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    check(rows, out.collect())
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(5) * [9, 3, 2, 1, 0.5]).tolist(), "clash") for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1], None)]
    bad = [(100, None, None), (101, [1.0, None, 0.0, 0.0, 0.0], None), (102, [math.nan] * 5, None), (103, [1.0, math.inf, 0.0, 0.0, 0.0], None), (104, [], None), (105, [1.0, 2.0], None)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    check(rows, got)
    assert {r["vec_id"] for r in got} == {r[0] for r in rows}


def test_no_variance_and_empty(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0, 3.0], None), (2, [1.0, 2.0, 3.0], None)], SCHEMA)
    got = whitening.whiten(frame).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got)
    assert whitening.whiten(frame.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], None) for i in range(9)], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert [r["whitened"] is None for r in got if r["vec_id"] == 0] == [False, True, True]


@pytest.mark.parametrize("spectrum", ["falling", "close", "flat"])
def test_iteration(spectrum):
    d, k = 90, 8
    e = {"falling": 0.8 ** np.arange(d), "close": 1 - 1e-4 * np.arange(d) / d, "flat": np.where(np.arange(d) < 20, 1.0, 0.1)}[spectrum]
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    got, u, worst = whitening.jacobi_davidson(lambda x: a @ x, d, k)
    assert np.abs(got - e[:k]).max() < 1e-12 and worst < 1e-12
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    assert np.abs(a @ whitening.minres(lambda x: a @ x, b, 40) - b).max() < 1e-8


def test_deviation_beyond_long():
    x = np.array([[1 << 40, 0], [1, 2]])
    assert whitening._deviations(x, np.array([1, 1]), 1 << 20) == [None, ((1 << 20) - 1) ** 2 + ((2 << 20) - 1) ** 2]
