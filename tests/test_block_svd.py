"""Block products, QR trees and the SVD against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import block_svd as B


def dense(df, ids):
    out = {}
    for i in ids:
        rows = sorted((r["at"], r["m"], bytes(r["x"])) for r in df.where(F.col("id") == i).collect())
        out[i] = np.vstack([np.frombuffer(x).reshape(m, -1) for _, m, x in rows])
    return out


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(6)
    low = rng.standard_normal((75, 3)) @ rng.standard_normal((3, 12))
    return {1: rng.standard_normal((90, 12)) * 0.7 ** np.arange(12), 2: low, 3: rng.standard_normal((5, 12)), 4: np.zeros((9, 12))}


@pytest.fixture(scope="module")
def blocked(spark, matrices):
    rows = [(k, i, j, m[i, 5 * j : 5 * j + 5].tolist()) for k, m in matrices.items() for i in range(len(m)) for j in range(3)]
    return B.blocks(spark.createDataFrame(rows, "id long, i long, j long, v array<double>"), j="j", size=4)


def test_qr_tree(blocked, matrices):
    tall = blocked.where("j = 0").drop("j")
    q, r = B.qr_tree(tall)
    q, r = dense(q, matrices), {x["id"]: np.frombuffer(x["x"]).reshape(x["m"], -1) for x in r.collect()}
    for k, m in matrices.items():
        assert np.abs(q[k].T @ q[k] - np.eye(q[k].shape[1])).max() < 1e-13
        assert np.abs(q[k] @ r[k] - m[:, :5]).max() < 1e-12


def test_svd(blocked, matrices):
    values, u, v = B.svd(blocked, 4, oversample=3, rounds=3)
    s = {r["id"]: (r["s"], r["frobenius"]) for r in values.collect()}
    u, v = dense(u, matrices), dense(v, matrices)
    for k, m in matrices.items():
        want = np.linalg.svd(m, compute_uv=False)[:4]
        assert s[k][0] == pytest.approx(want.tolist(), rel=1e-4, abs=1e-9) and s[k][1] == pytest.approx(np.linalg.norm(m))
        n = int((np.array(s[k][0]) > 1e-8).sum())
        assert np.abs((m @ v[k])[:, :n] - u[k][:, :n] * s[k][0][:n]).max(initial=0) < 2e-2 * max(1, want[0])
        assert np.abs(v[k].T @ v[k] - np.eye(4)).max() < 1e-10
    same = {r["id"]: r["phi"] for r in B.overlap(B.svd(blocked.where("id = 1"), 4)[1], B.svd(blocked.where("id = 1"), 4)[1], 4).collect()}
    assert same == {1: pytest.approx(1.0)}


def test_collective(spark):
    name = "model.layers.{}.self_attn.{}_proj.weight"
    rows = [(g, name.format(layer, p), [1.0] * (layer + 1)) for g in (1, 2) for layer in range(2) for p in "qkvo"] + [(1, "model.layers.0.mlp.up_proj.weight", [5.0, 5.0]), (1, "lm_head.weight", [1.0])]
    got = {r["group_id"]: tuple(r)[1:] for r in B.collective_scores(spark.createDataFrame(rows, "group_id long, name string, s array<double>")).collect()}
    assert got[1] == got[2] == pytest.approx((2, 3, 3, 3, 3, 12))
    for bad in (rows[:-3], [*rows[:8], rows[0]]):
        with pytest.raises(Exception, match="unequal or repeated"):
            B.collective_scores(spark.createDataFrame(bad, "group_id long, name string, s array<double>")).collect()
