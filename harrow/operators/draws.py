"""Exact draws with replacement, by weight, from tables of any size.

A multinomial falls apart into binomials: of n draws from a node, Binomial(n, left weight / weight) go to its left child and the rest to
its right one. Rows are the leaves of a tree over the bits of their hashed keys. The weights of nodes are sums of Spark; the nodes at
every twelfth bit are dealt their draws together, in one call for each parent, and the rows of a last node likewise, so no
task sees more than a node's children. The generator of a node is seeded by the seed and the node, so reruns agree, and
sums are written before they are used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.segments import array, schema_of, whole_groups
from harrow.sources.tables import cut

#: Bits of the hash that one call splits by; rows of a last node, about.
BITS, LEAF = 12, 2048


def dealt(draws: int, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How often each weight is drawn: binomial splits down a binary tree. Without any weight nothing is drawn."""
    n = len(weights)
    sums = [np.zeros(1 << max(0, (n - 1).bit_length()))]
    sums[0][:n] = weights
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    if not sums[-1][0] > 0:
        return np.zeros(n, np.int64)
    got = np.array([draws], np.int64)
    for level in reversed(sums[:-1]):
        pair = level.reshape(-1, 2)
        total = pair.sum(axis=1)
        left = rng.binomial(got, np.divide(pair[:, 0], total, out=np.zeros(len(pair)), where=total > 0))
        got = np.stack([left, got - left], axis=1).reshape(-1)
    return got[:n]


def _split(rows: DataFrame, node: str, order: list[str], seed: int, depth: int, name: str) -> DataFrame:
    """Adds ``name``: the draws of each row's node (column draws) dealt to its rows by weight."""

    def run(t: pa.Table, begins: np.ndarray) -> pa.Table:
        nodes, n, w = array(t, node).to_numpy(), array(t, "__draws").to_numpy(), array(t, "__w").to_numpy()
        ends = np.append(begins[1:], len(w))
        out = np.empty(len(w), np.int64)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            rng = np.random.default_rng([seed & (1 << 63) - 1, depth, int(nodes[a]) & (1 << 63) - 1])
            out[a:b] = dealt(int(n[a]), w[a:b], rng)
        return t.append_column(name, pa.array(out))

    return whole_groups(rows, [node], order, run, schema_of(rows, f"`{name}` long"))


def multinomial(df: DataFrame, key: list[str], weight: Column, draws: int | None = None, seed: int = 0, name: str = "copies", bits: int = BITS, leaf: int = LEAF) -> DataFrame:
    """Adds ``name``: how often a row is drawn in ``draws`` independent draws by weight (as many as rows, if not given).
    ``key`` names a row; a null or negative weight is none."""
    rows = df.withColumn("__w", F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))).withColumn("__h", F.xxhash64(F.lit(seed), *key))
    rows = cut(rows)
    n = rows.count()
    deep = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    depths = [*range(bits, deep, bits), deep] if deep else []
    at = lambda d: F.shiftrightunsigned("__h", 64 - d)
    got = df.sparkSession.createDataFrame([(0, n if draws is None else draws)], "__node long, __draws long")
    before = 0
    for d in depths:
        sums = rows.groupBy(at(d).alias("__child")).agg(F.sum("__w").alias("__w")).withColumn("__node", F.shiftrightunsigned("__child", d - before))
        sums = cut(sums)
        got = _split(sums.join(got, "__node"), "__node", ["__child"], seed, before, "__own").select(F.col("__child").alias("__node"), F.col("__own").alias("__draws"))
        got, before = cut(got), d
    rows = rows.withColumn("__node", at(before) if before else F.lit(0).cast("long")).join(got, "__node")
    return _split(rows, "__node", ["__h", *key], seed, before, name).drop("__w", "__h", "__node", "__draws")
