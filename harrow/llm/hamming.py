"""Near copies by a multi-index Hamming join of min-hash signatures.

Every distinct set of word shingles is a point whose signature has ``COORDINATES`` min-hash coordinates of 8 bits. Two sets agree
on a coordinate with the probability of their similarity, so similar sets have signatures that differ in few coordinates.
The signature is split into ``CHUNKS`` chunks. If two signatures differ in at most 2 x ``CHUNKS`` - 1
coordinates, then by the pigeonhole principle some chunk differs in at most one; so each chunk is filed once for each of its
coordinates, with that one left out, and the two meet in one of these buckets for certain. At a similarity of 0.85 the number of
differences of 64 coordinates passes 21 with probability 0.0001 (:func:`miss`).

Buckets give no pairs but the edges of a forest over pairs within the distance. A bucket of more than ``SMALL`` points is
cut into chunks that all hold its first point, and each chunk gives its forest. Where its points then still lie in different
components of all edges, those outside the bucket's largest component are compared with all others, chunk by chunk; so every
pair within the distance ends in one component, whatever the size of its buckets. The components are then compared exactly, on
full sets (:mod:`jaccard`). Copies of a set are one point throughout.

Defined results: a null text, or one without words, has no shingles: it is linked with nothing; a text of fewer words than a shingle
is one shingle; repeated rows are copies of each other; a component is named by its least id (nulls only if there is no
other); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard

WORDS, THRESHOLD, CHUNKS, SMALL = 3, 0.85, 11, 2048
COORDINATES = jaccard.COORDINATES
#: Where each chunk begins; they are as equal as can be.
_CHUNKS_AT = [COORDINATES * c // CHUNKS for c in range(CHUNKS + 1)]
_RNG = np.random.default_rng(20_26)
_MUL = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def miss(threshold: float = THRESHOLD, distance: int = 2 * CHUNKS - 1) -> float:
    """Probability that sets of this similarity have signatures farther apart than ``distance``."""
    return sum(math.comb(COORDINATES, d) * (1 - threshold) ** d * threshold ** (COORDINATES - d) for d in range(distance + 1, COORDINATES + 1))


def _signatures(rows: pa.Table) -> np.ndarray:
    return (jaccard._sketches(rows) & 255).astype(np.uint8)


def _filed(points: DataFrame) -> DataFrame:
    """(path, set): each point under the keys of all its chunks with one coordinate left out."""

    def run(rows: pa.Table) -> pa.Table:
        s = _signatures(rows).astype(np.uint64) + np.uint64(1)
        parts = common.mix64(s * _MUL)
        keys = np.empty(s.shape, np.uint64)
        for a, b in zip(_CHUNKS_AT[:-1], _CHUNKS_AT[1:], strict=True):
            whole = parts[:, a:b].sum(axis=1)
            for j in range(a, b):
                keys[:, j] = common.mix64(whole - parts[:, j] + np.uint64(j))
        who = np.repeat(np.arange(rows.num_rows), COORDINATES)
        return pa.table({"path": pa.array(keys.reshape(-1).view(np.int64)), "set": common.column(rows, "set").take(pa.array(who))})

    return common.arrow_pass(points.select("set", "sketch"), run, "path long, set binary")


def _near(sketch: np.ndarray, i: int, of: np.ndarray, distance: int) -> np.ndarray:
    return (sketch[of] != sketch[i]).sum(axis=1) <= distance


def _forests(rows: pa.Table, groups: list[tuple[int, int]], distance: int) -> pa.Table:
    keys, sketch = common.column(rows, "set").to_pylist(), _signatures(rows)
    edges = []
    for a, b in groups:
        # by their keys, so that buckets of the same points have the same edges
        order = sorted(range(a, b), key=keys.__getitem__)
        own = sketch[order]
        edges += jaccard.forest_edges([keys[i] for i in order], jaccard.forest(lambda i, of, s=own: _near(s, i, of, distance), b - a))
    return jaccard.pair_table(edges)


def _across(rows: pa.Table, groups: list[tuple[int, int]], distance: int) -> pa.Table:
    """Edges between rows that are ``asked`` and rows of other components within the distance; one for each two components."""
    keys, sketch, root = common.column(rows, "set").to_pylist(), _signatures(rows), common.column(rows, "root").to_pylist()
    asked = common.column(rows, "asked").to_numpy(zero_copy_only=False)
    edges = []
    for a, b in groups:
        number: dict[bytes, int] = {}
        label = np.array([number.setdefault(r, len(number)) for r in root[a:b]])
        mine, others = a + np.flatnonzero(asked[a:b]), a + np.flatnonzero(~asked[a:b])
        found = set()
        for i in mine.tolist():
            of = others[label[others - a] != label[i - a]]
            if len(of):
                for j in of[_near(sketch, i, of, distance)].tolist():
                    two = (int(label[i - a]), int(label[j - a]))
                    if two not in found:
                        found.add(two)
                        edges.append((keys[i], keys[j]))
    return jaccard.pair_table(edges)


def near_pairs(points: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of signatures that differ in at most 2 x CHUNKS - 1 coordinates.
    ``points`` has distinct sets and their sketches."""
    distance = 2 * CHUNKS - 1
    nodes, filed = _filed(points), COORDINATES * points.count()
    sketches = points.select("set", "sketch")
    size = common.cut(nodes.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), filed)
    few = nodes.join(size.where(F.col("size") <= small).select("path"), "path").join(sketches, "set").select("path", "set", "sketch")
    found = jaccard.sorted_groups(few, ["path"], lambda rows, groups: _forests(rows, groups, distance), jaccard.PAIR).distinct()
    large = size.where(F.col("size") > small)
    if large.isEmpty():
        return found
    chunks = F.ceil(F.col("size") / (small // 2)).cast("long")
    total = large.agg(F.sum("size").alias("n")).first()["n"]
    crowd = common.cut(common.hot_join(nodes, large.withColumn("chunks", chunks), "path", "size", total).withColumn("i", F.pmod(F.xxhash64("set"), F.col("chunks"))), total)
    # the first point goes to every chunk
    pivots = crowd.groupBy("path", "chunks").agg(F.min("set").alias("set"))
    pivots = pivots.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("i"), "set")
    local = crowd.select("path", "i", "set").unionByName(pivots).distinct().join(sketches, "set")
    local = jaccard.sorted_groups(local, ["path", "i"], lambda rows, groups: _forests(rows, groups, distance), jaccard.PAIR)
    found = common.cut(found.unionByName(local).distinct(), filed)
    roots = jaccard.components(found).withColumnRenamed("v", "set")
    crowd = crowd.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    crowd = common.cut(crowd.select("path", "size", "chunks", "i", "set", "root"), total)
    shares = crowd.groupBy("path", "root").agg(F.count("*").alias("n"))
    most = shares.groupBy("path").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    split = common.cut(most.where("most.n < all").select("path", F.col("most.root").alias("main"), (F.col("all") - F.col("most.n")).alias("apart"), "all"), total)
    if split.isEmpty():
        return found
    part = F.ceil(F.col("apart") / (small // 2)).cast("long")
    rows = common.hot_join(crowd, split, "path", "all", total).withColumn("parts", part).withColumn("j", F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts")))
    ask = rows.where("root <> main").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("i"), "j", "set", "root", F.lit(True).alias("asked"))
    be_asked = rows.select("path", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), "set", "root", F.lit(False).alias("asked"))
    grid = ask.unionByName(be_asked).join(sketches, "set")
    more = jaccard.sorted_groups(grid, ["path", "i", "j"], lambda rows, groups: _across(rows, groups, distance), jaccard.PAIR)
    return found.unionByName(more)


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id it is linked to, over links of links) and kept (is it
    that document?)."""
    points, classes, total = jaccard.classes_of(jaccard.named_rows(docs, id, text), words, threshold, False, fold=True, pairs=near_pairs, small=small)
    got = common.hot_join(points.where("set is not null"), classes, "set", "copies", total).select("id", "n", F.col("class.id").alias("component"))
    got = got.unionByName(points.where("set is null").select("id", "n", F.col("id").alias("component")))
    return got.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
