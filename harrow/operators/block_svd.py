"""Truncated SVD of matrices that no row and no task can hold.

A matrix lies in blocks of ``ROWS`` rows and as many columns as its slices have. The range finder multiplies it with a random
matrix, each task making the rows of that it needs from the seed, then alternates products with the transpose and the matrix. A product is
a join of blocks with blocks of the tall, thin factor and a sum over the blocks; partial sums are made where the products are. Tall
factors are made orthonormal by a QR tree: each block is factored where it is, the triangles of ``FAN`` neighbours are stacked and factored
until one is left, and on the way back each block is multiplied with its part of every orthogonal factor above it, so the result is as
orthonormal as one Householder QR, for deficient ranks too. Only matrices of rank x rank ever stand alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.segments import array, whole_groups
from harrow.operators.spectral import classify, effective_rank
from harrow.sources.tables import cut

ROWS, FAN, HELD = 1024, 8, 64 << 20
#: A block of a matrix or a factor: its id, place and number of rows, and its entries as doubles.
_BLOCK = "{kind}, at long, m int, x binary"


def _entries(x: pa.Scalar, m: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.float64).reshape(m, -1) if m else np.zeros((0, 0))


def _table(kind: pa.DataType, rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, [kind, *kinds], strict=True)})


def blocks(rows: DataFrame, id: str = "id", i: str = "i", v: str = "v", j: str | None = None, size: int = ROWS) -> DataFrame:
    """(id, at, j, m, x) of rows (id, i, v): v is row i, or its slice number j, all slices of a number being of one width. Rows that
    are not given are left out, which changes no singular value."""
    df = rows.select(F.col(id).alias("id"), F.floor(F.col(i) / size).cast("long").alias("at"), (F.lit(0) if j is None else F.col(j)).cast("long").alias("j"), F.col(i).cast("long").alias("i"), F.col(v).cast("array<double>").alias("v"))

    def run(t: pa.Table, begins: np.ndarray) -> pa.Table:
        out = []
        for a, b in zip(begins.tolist(), np.append(begins[1:], t.num_rows).tolist(), strict=True):
            part = t.slice(a, b - a)
            out.append((part["id"][0].as_py(), part["at"][0].as_py(), part["j"][0].as_py(), b - a, array(part, "v").flatten().to_numpy(zero_copy_only=False).tobytes()))
        return _table(t.schema.field("id").type, out, ["id", "at", "j", "m", "x"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()])

    return whole_groups(df, ["id", "at", "j"], ["i"], run, f"id {dict(df.dtypes)['id']}, at long, j long, m int, x binary")


def _summed(products: DataFrame, fn: Callable[[dict], tuple[object, int, np.ndarray]], kind: str) -> DataFrame:
    """The sums over (id, at) of what ``fn`` makes of each row: first in the tasks, up to ``HELD`` bytes, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def out(t: pa.DataType) -> Iterator[pa.RecordBatch]:
            for (key, at), x in held.items():
                yield from _table(t, [(key, at, len(x), x.tobytes())], ["id", "at", "m", "x"], [pa.int64(), pa.int32(), pa.binary()]).to_batches()
            held.clear()

        t = None
        for batch in batches:
            t = batch.schema.field("id").type
            for r in batch.to_pylist():
                key, at, x = fn(r)
                if (key, at) in held:
                    held[key, at] += x
                else:
                    held[key, at] = x
                    size += x.nbytes
                if size > HELD:
                    yield from out(t)
                    size = 0
        if held:
            yield from out(t)

    def total(t: pa.Table, begins: np.ndarray) -> pa.Table:
        rows = []
        for a, b in zip(begins.tolist(), np.append(begins[1:], t.num_rows).tolist(), strict=True):
            m = t["m"][a].as_py()
            x = sum((_entries(t["x"][k], m) for k in range(a + 1, b)), start=_entries(t["x"][a], m).copy())
            rows.append((t["id"][a].as_py(), t["at"][a].as_py(), m, x.tobytes()))
        return _table(t.schema.field("id").type, rows, ["id", "at", "m", "x"], [pa.int64(), pa.int32(), pa.binary()])

    schema = _BLOCK.format(kind=f"id {kind}")
    return whole_groups(products.mapInArrow(run, schema), ["id", "at"], [], total, schema)


def _matrix(r: dict, name: str, m: str) -> np.ndarray:
    return np.frombuffer(r[name]).reshape(r[m], -1)


def times(a: DataFrame, right: DataFrame) -> DataFrame:
    """A X, in A's row blocks; ``right`` has X's rows in A's column blocks."""
    both = a.join(right.select("id", F.col("at").alias("j"), F.col("m").alias("n"), F.col("x").alias("y")), ["id", "j"])
    return _summed(both, lambda r: (r["id"], r["at"], _matrix(r, "x", "m") @ _matrix(r, "y", "n")), dict(a.dtypes)["id"])


def transposed_times(a: DataFrame, left: DataFrame) -> DataFrame:
    """A' Y, in A's column blocks."""
    both = a.join(left.select("id", "at", F.col("m").alias("n"), F.col("x").alias("y")), ["id", "at"])
    return _summed(both, lambda r: (r["id"], r["j"], _matrix(r, "x", "m").T @ _matrix(r, "y", "n")), dict(a.dtypes)["id"])


def _random_times(a: DataFrame, q: int, seed: int) -> DataFrame:
    def product(r: dict) -> tuple[object, int, np.ndarray]:
        x = _matrix(r, "x", "m")
        return r["id"], r["at"], x @ np.random.default_rng([seed, r["j"]]).standard_normal((x.shape[1], q))

    return _summed(a, product, dict(a.dtypes)["id"])


def qr_tree(y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orthonormal blocks (id, at, m, x) and the triangle (id, m, x) of each tall matrix in blocks (id, at, m, x)."""
    kind = dict(y.dtypes)["id"]
    part = f"id {kind}, at long, m int, x binary, n int, r binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.schema.field("id").type
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("id", "at", "m", "x")}
                q, r = np.linalg.qr(_entries(row["x"], row["m"].as_py()))
                yield from _table(t, [(row["id"].as_py(), row["at"].as_py(), len(q), q.tobytes(), len(r), r.tobytes())], ["id", "at", "m", "x", "n", "r"], [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]).to_batches()

    def stacked(t: pa.Table, begins: np.ndarray) -> pa.Table:
        out = []
        for a, b in zip(begins.tolist(), np.append(begins[1:], t.num_rows).tolist(), strict=True):
            parts = [_entries(t["x"][k], t["m"][k].as_py()) for k in range(a, b)]
            q, r = np.linalg.qr(np.vstack(parts))
            cuts = np.append(0, np.cumsum([len(p) for p in parts])).tolist()
            for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                out.append((t["id"][a].as_py(), t["at"][a + k].as_py(), t["up"][a].as_py(), hi - lo, q[lo:hi].tobytes(), len(r) if k == 0 else None, r.tobytes() if k == 0 else None))
        return _table(t.schema.field("id").type, out, ["id", "at", "up", "m", "x", "n", "r"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()])

    leaves = cut(y.mapInArrow(local, part))
    most = (leaves.agg(F.max("at").alias("at")).first()["at"] or 0) + 1
    tops, levels = leaves.select("id", "at", F.col("n").alias("m"), F.col("r").alias("x")), []
    while most > 1:
        up = tops.withColumn("up", F.floor(F.col("at") / FAN).cast("long"))
        level = cut(whole_groups(up, ["id", "up"], ["at"], stacked, f"id {kind}, at long, up long, m int, x binary, n int, r binary"))
        levels.append(level)
        tops = level.where("r is not null").select("id", F.col("up").alias("at"), F.col("n").alias("m"), F.col("r").alias("x"))
        most = -(-most // FAN)
    triangle = tops.select("id", "m", "x")

    def multiplied(below: DataFrame, above: DataFrame) -> DataFrame:
        both = below.join(above.select("id", F.col("at").alias("up"), F.col("m").alias("n"), F.col("x").alias("y")), ["id", "up"])
        return _summed(both, lambda r: (r["id"], r["at"], _matrix(r, "x", "m") @ _matrix(r, "y", "n")), kind)

    down = None
    for level in reversed(levels):
        below = level.select("id", "at", "up", "m", "x")
        down = below.drop("up") if down is None else multiplied(below, down)
    q = leaves.select("id", "at", "m", "x")
    return (q if down is None else multiplied(q.withColumn("up", F.col("at")), down)), triangle


def svd(a: DataFrame, rank: int, oversample: int = 8, rounds: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, s, frobenius) of each matrix in blocks, its leading left vectors (id, at, m, x) in its row blocks, and the right ones in its
    column blocks: singular values from the largest, ``rank`` of them or as many as the smaller side has."""
    kind = dict(a.dtypes)["id"]
    a = cut(a)
    q = cut(qr_tree(_random_times(a, rank + oversample, seed))[0])
    for _ in range(rounds):
        z = cut(qr_tree(transposed_times(a, q))[0])
        q = cut(qr_tree(times(a, z))[0])
    right, triangle = qr_tree(transposed_times(a, q))

    def small(rows: pa.Table) -> pa.Table:
        out = []
        for r in rows.to_pylist():
            w, s, v = np.linalg.svd(_matrix(r, "x", "m").T, full_matrices=False)
            k = min(rank, len(s))
            out.append((r["id"], s[:k].tolist(), len(w), np.ascontiguousarray(w[:, :k]).tobytes(), v.shape[1], np.ascontiguousarray(v[:k].T).tobytes()))
        return _table(rows.schema.field("id").type, out, ["id", "s", "mw", "w", "mv", "v"], [pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.int32(), pa.binary()])

    core = triangle.mapInArrow(lambda bs: (y for b in bs for y in small(pa.Table.from_batches([b])).to_batches()), f"id {kind}, s array<double>, mw int, w binary, mv int, v binary")
    core = cut(core)

    def turned(factor: DataFrame, by: str) -> DataFrame:
        both = factor.join(core.select("id", F.col(f"m{by}").alias("n"), F.col(by).alias("y")), "id")
        return _summed(both, lambda r: (r["id"], r["at"], _matrix(r, "x", "m") @ _matrix(r, "y", "n")), kind)

    norm = _summed(a, lambda r: (r["id"], 0, np.array([[np.square(np.frombuffer(r["x"])).sum()]])), kind)
    norm = norm.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column("id"), pa.array([float(np.sqrt(np.frombuffer(x.as_buffer())[0])) for x in b.column("x")], pa.float64())], ["id", "frobenius"]) for b in bs), f"id {kind}, frobenius double")
    return core.select("id", "s").join(norm, "id"), turned(q, "w"), turned(right, "v")


def overlap(u: DataFrame, other: DataFrame, rank: int) -> DataFrame:
    """(id, phi): squared overlap of two sets of orthonormal columns in blocks, over ``rank``."""
    both = u.join(other.select("id", "at", F.col("m").alias("n"), F.col("x").alias("y")), ["id", "at"])
    sums = _summed(both, lambda r: (r["id"], 0, _matrix(r, "x", "m").T @ _matrix(r, "y", "n")), dict(u.dtypes)["id"])
    return sums.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column("id"), pa.array([min(1.0, float(np.square(np.frombuffer(x.as_buffer())).sum()) / rank) for x in b.column("x")], pa.float64())], ["id", "phi"]) for b in bs), f"id {dict(u.dtypes)['id']}, phi double")


def collective_scores(spectra: DataFrame, group: str = "group_id", name: str = "name", s: str = "s") -> DataFrame:
    """(group, layers, q, k, v, o, score) from the spectra of all parameters of a group: effective ranks summed over layers, then over the
    four attention projections; other parameters are passed over. A projection that is missing, comes twice for a layer or has another
    number of layers is an error. A zero spectrum counts 0."""
    found = classify(F.col(name))
    rows = spectra.where(F.col(name).rlike(r"self_attn\..*weight$")).select(group, found["layer"].alias("layer"), found["family"].alias("family"), effective_rank(F.col(s)).alias("rank")).where(F.col("family").isin("Q", "K", "V", "O"))
    by = rows.groupBy(group).agg(F.count("*").alias("rows"), F.countDistinct("layer", "family").alias("once"), *(F.count_if(F.col("family") == f).alias(f"n_{f}") for f in "QKVO"), *(F.sum(F.when(F.col("family") == f, F.col("rank")).otherwise(0.0)).alias(f.lower()) for f in "QKVO"))
    even = (F.greatest(*(F.col(f"n_{f}") for f in "QKVO")) == F.least(*(F.col(f"n_{f}") for f in "QKVO"))) & (F.col("rows") == F.col("once"))
    layers = F.when(even, F.col("n_Q")).otherwise(F.raise_error(F.concat(F.lit("projections of unequal or repeated layers in group "), F.col(group).cast("string"))).cast("long"))
    return by.select(group, layers.alias("layers"), "q", "k", "v", "o", (F.col("q") + F.col("k") + F.col("v") + F.col("o")).alias("score"))
