"""Whitening of embeddings by the leading eigenvectors of their covariance, found with Jacobi-Davidson.

The covariance V is never formed. A product V u is one pass over the vectors: tasks centre their blocks, multiply by all u
of the round at once and by the transpose, and Spark adds the tasks' sums. The search space Q starts at random; each round takes
the Ritz vectors of Q' V Q (Rayleigh-Ritz), locks the leading ones whose residual is at double precision, and for the others solves the
correction equation (1 - PP')(V - theta)(1 - PP') t = -r by a few steps of MINRES, all equations in the same passes;
P holds the locked and the present Ritz vectors. The corrections join Q, which shrinks to its best Ritz vectors when it grows
beyond ``MOST``. A few guard vectors beyond the wanted ones are corrected too, so that close eigenvalues come in the right order.

The vectors' entries c become whole numbers x = floor(1024 c) + 100000, written once to the shared folder in blocks. The means
S / n are kept as a whole and a fractional part, so that centred entries carry one rounding. What the driver gets of a pass are as many
numbers as V u has.

Defined results: rows are dropped whose vector is null, or holds null, infinite or NaN entries, entries beyond 2^42 (x must stay exact in
double arithmetic), or whose length isn't the commonest one (of equally common ones the largest); a null id is an id as any other; repeated rows are rows of
their own; fewer dimensions than components give as many components; a component without variance has whitened null, and its
explained is 0 (null without any variance); a deviation that no long holds is null; equal eigenvalues give some basis; a component's sign makes its
largest entry positive; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS, GUARDS, INNER, MOST, ROUNDS = 8, 4, 6, 40, 200
SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 42)
#: Bytes of a block, and of the vectors that a task gets at least.
BLOCK, TASK = 1 << 20, 8 << 20
#: Residuals count as zero below this share of the largest eigenvalue; and a component's variance.
TOLERANCE, RANK = 2e-14, 1e-13

Apply = Callable[[np.ndarray], np.ndarray]


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64) + SHIFT


def clean(rows: DataFrame, id: str, vector: str) -> tuple[DataFrame, int, int]:
    """(id, v) of the vectors to use, their number and their length."""
    cleaned = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # NaN is above all numbers
    cleaned = cleaned.where(F.forall("v", lambda c: F.coalesce(F.abs(c) <= LIMIT, F.lit(False))))
    lengths = cleaned.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    n, d = (lengths[0]["n"], lengths[0]["d"]) if lengths else (0, 0)
    return cleaned.where(F.size("v") == d), n, d


def _entries(rows: pa.Table, d: int) -> np.ndarray:
    lists = common.column(rows, "v")
    return whole(lists.flatten().to_numpy().reshape(-1, d))


def _sums(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int, d: int) -> np.ndarray:
    """The sum over all blocks of ``fn``'s result, an array of ``size`` doubles; tasks add up their blocks first."""
    common.bound_batches(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += fn(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "x"])

    got = blocks.select("x").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return out


def _blocks(vectors: DataFrame, d: int) -> DataFrame:
    """(x) blocks of whole numbers, row by row."""

    def run(rows: pa.Table) -> pa.Table:
        x, step = _entries(rows, d), max(1, BLOCK // (8 * d))
        return pa.table({"x": pa.array([x[a : a + step].tobytes() for a in range(0, len(x), step)], pa.binary())})

    return common.arrow_pass(vectors.select("v"), run, "x binary")


def _totals(blocks: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension: of the upper and the lower bits, so that no long overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                x = np.frombuffer(b.as_buffer(), np.int64).reshape(-1, d)
                up, low = (x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(up), pa.array(low)], ["i", "up", "low"])

    got = blocks.select("x").mapInArrow(run, "i int, up long, low long").groupBy("i").agg(F.sum("up").alias("up"), F.sum("low").alias("low")).collect()
    by = {r["i"]: (r["up"] << 26) + r["low"] for r in got}
    return [by[i] for i in range(d)]


def minres(apply: Apply, right: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` of MINRES from zero for every column of ``right``, side by side; ``apply`` is symmetric."""
    x = np.zeros_like(right)
    v, v_old, w, w_old = right.copy(), np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta = np.linalg.norm(v, axis=0)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    tiny = np.finfo(float).tiny
    for _ in range(steps):
        v = v / np.maximum(beta, tiny)
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        v_new = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        delta = c * alpha - c_old * s * beta
        r1, r2, r3 = np.maximum(np.hypot(delta, beta_new), tiny), s * alpha + c_old * c * beta, s_old * beta
        c_old, c, s_old, s = c, delta / r1, s, beta_new / r1
        w, w_old = (v - r3 * w_old - r2 * w) / r1, w
        x = x + c * eta * w
        eta = -s * eta
        v_old, v, beta = v, v_new, beta_new
    return x


def _orthogonal(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The part of ``t``'s columns that is new to ``q``, as orthonormal columns."""
    out = []
    for col in t.T:
        size = np.linalg.norm(col)
        for _ in range(3):
            col = col - q @ (q.T @ col)
            for o in out:
                col = col - o * (o @ col)
        left = np.linalg.norm(col)
        if size > 0 and left > 1e-8 * size:
            out.append(col / left)
    return np.array(out).T.reshape(len(t), -1)


def jacobi_davidson(apply: Apply, d: int, k: int, seed: int = 7, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues, falling, their unit eigenvectors as columns, and the largest residual."""
    rng = np.random.default_rng(seed)
    wide = min(d, k + GUARDS)
    q = np.linalg.qr(rng.standard_normal((d, wide)))[0]
    aq = apply(q)
    before, stale = np.inf, 0
    for _ in range(rounds):
        theta, y = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, a_ritz = q @ y, aq @ y
        theta, ritz = theta[:wide], ritz[:, :wide]
        r = a_ritz[:, :wide] - ritz * theta
        size = np.linalg.norm(r, axis=0)
        bad = size > TOLERANCE * max(theta[0], 0.0)
        worst = size[:k].max()
        locked = k if not bad[:k].any() else int(np.argmax(bad[:k]))
        # residuals that no longer fall are at the precision of the products
        stale = stale + 1 if worst > 0.5 * before else 0
        before = min(before, worst)
        if locked == k or (stale >= 3 and worst <= 1e-12 * theta[0]):
            # the products of Q were carried along; these are made anew
            true = float(np.linalg.norm(apply(ritz[:, :k]) - ritz[:, :k] * theta[:k], axis=0).max())
            if true <= TOLERANCE * theta[0] or stale >= 3:
                worst = true
                break
            q, before = np.linalg.qr(q)[0], np.inf
            aq = apply(q)
            continue
        if q.shape[1] + wide - locked > min(MOST, d) and q.shape[1] > wide:
            kept = min(q.shape[1], wide + k)
            q, aq = q @ y[:, :kept], aq @ y[:, :kept]
        if q.shape[1] == d:
            q = np.linalg.qr(q)[0]
            aq = apply(q)
            continue
        shift = theta[locked:]

        def projected(u: np.ndarray) -> np.ndarray:
            u = apply(off(u)) - off(u) * shift
            return off(u)

        def off(u: np.ndarray) -> np.ndarray:
            return u - ritz @ (ritz.T @ u)

        new = _orthogonal(q, off(minres(projected, off(-r[:, locked:]), INNER)))
        if not new.shape[1]:
            new = _orthogonal(q, rng.standard_normal((d, min(wide, d - q.shape[1]))))
        q, aq = np.hstack([q, new]), np.hstack([aq, apply(new)])
    return theta[:k], ritz[:, :k], float(worst)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = next(k for c, k in rows.dtypes if c == id)
    vectors, n, d = clean(rows, id, vector)
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    blocks, path = common.store(_blocks(vectors.coalesce(max(1, 8 * n * d // TASK)), d))
    total = _totals(blocks, d)
    base, over = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base).astype(np.float64) - rest

    def apply(u: np.ndarray) -> np.ndarray:
        u = np.ascontiguousarray(u)

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return (c.T @ (c @ u)).reshape(-1)

        return _sums(blocks, part, u.size, d).reshape(u.shape) / n

    k = min(components, d)
    trace = float(_sums(blocks, lambda x: np.array([(centred(x) ** 2).sum()]), 1, d)[0] / n)
    if trace > 0:
        e, u, _ = jacobi_davidson(apply, d, k)
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    else:
        e, u = np.zeros(k), np.eye(d)[:, :k]
    live = e > RANK * max(e[0], 0.0)
    scale = np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), np.nan)
    some = np.flatnonzero(live)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (centred(x) @ u * scale)[:, some]
        return np.append(w.sum(axis=0), (w.T @ w).reshape(-1))

    error = None
    if len(some):
        m = _sums(blocks, moments, len(some) * (len(some) + 1), d)
        mean = m[: len(some)] / n
        cov = m[len(some) :].reshape(len(some), -1) / n - np.outer(mean, mean)
        error = float(np.abs(cov - np.eye(len(some))).max())
    common.remove(spark, path)
    explained = e / trace if trace > 0 else np.full(k, np.nan)

    def out(rows: pa.Table) -> pa.Table:
        x = _entries(rows, d)
        w = centred(x) @ u * scale
        deviation = _deviations(x - base, over, n)
        m = len(x)
        flat, share = w.reshape(-1), np.tile(explained, m)
        return pa.table({
            "id": common.column(rows, "id").take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, n)),
            "deviation": pa.array([x for x in deviation for _ in range(k)], pa.int64()), "whitened": pa.array(flat, mask=np.isnan(flat)), "explained": pa.array(share, mask=np.isnan(share)), "identity_error": pa.array([error] * (m * k), pa.float64()),
        })

    return common.arrow_pass(vectors, out, schema).withColumnRenamed("id", id)


def _deviations(x: np.ndarray, over: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n x - over)^2 for each row, exactly; null where no long holds it."""
    most = int(np.abs(x).max(initial=0)) * n + int(np.abs(over).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - over) ** 2).sum(axis=1).tolist()
    sums = ((n * x.astype(object) - over.astype(object)) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in sums]
