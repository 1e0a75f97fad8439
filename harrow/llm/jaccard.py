"""Similarity join of word shingles by chosen paths.

Every distinct shingle set is a point with ``COORDINATES`` min-hash coordinates, on each of which two
sets agree with the probability of their Jaccard similarity. A run starts with all points in one
bucket; a bucket's node picks coordinates by a seeded hash, each with probability 1 / (threshold x
coordinates), and splits its points by the value there. After two levels, buckets of at most ``small``
points are compared pair by pair on their coordinates. In a larger one the points that are likely links
of its pivot are linked to that and only the pivot goes on, as no split divides a group of near copies; the rest is
split again, and what is still large after ``depth`` levels is compared chunk by chunk. A pair at the
threshold survives two levels of a run with probability 0.47, so ``runs`` runs (12) find it with
probability 0.9994, and closer pairs sooner. Further levels lose pairs, so points in large buckets get as
many more runs as keep that probability at the last level (:func:`recall`, :func:`runs_at`).

Buckets emit no pairs but the edges of a spanning forest of the likely pairs. Their components are
then compared exactly. One text of each set is shingled; a component of one chunk is compared at once, which
yields each set's number of links and a spanning forest of the true links, whose components are the classes. In a
larger component each set is written as its differences from the component's root, which is a small
part of it among near copies, and the chunks of differences are compared in pairs. A set of a component of c chunks so
is sent c times as differences, never as a whole; where only the classes are asked for, sets linked to the root
are compared only with those that aren't. The number of links of a set is a count over all its pairs, so its cost grows with the
square of a component of different texts. Copies of a set are one point throughout; their number comes back as a weight.

Defined results: a null text, or one without words, has no shingles: it is a class of its own with no
links; a text of fewer words than a shingle is one shingle; repeated rows are copies of each other;
a class is named by its least id (nulls only if there is no other); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD, COORDINATES, RUNS, DEPTH, SMALL = 5, 0.8, 64, 12, 5, 4096
#: Likely pairs agree on this much less than the threshold; four standard deviations at 64 coordinates.
SLACK = 0.2
#: A chunk of a component has about this many shingles, and sets.
CHUNK_SHINGLES, CHUNK_SETS = 250_000, 512
#: Bytes of texts that are cut into shingles at once.
STRETCH = 1 << 20
#: The same of a chunk of differences.
CHUNK_DIFFERENCES, CHUNK_SHORT = 250_000, 1024
_RNG = np.random.default_rng(20_24)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_WORD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MUL = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array, words: int = WORDS, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit numbers, and the n + 1 offsets; ``fold`` lower-cases A to Z. Texts are
    taken some ``STRETCH`` bytes at a time, as their letters need many times their own memory."""
    raw, ends = common.utf8(texts)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], STRETCH)), [0, len(ends) - 1]))
    parts = [_shingles(_LOWER[x] if fold else x, ends[a : b + 1] - ends[a], words) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for x in [raw[ends[a] : ends[b]]]]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([x for x, _ in parts]), np.append(0, np.cumsum(sizes))


def _shingles(raw: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    ink = ~_WHITE[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    inner = ends[:-1][ends[:-1] < len(raw)]
    begins[inner] |= ink[inner]
    first = np.flatnonzero(begins[ink])  # of each word among the inked bytes
    n_words = np.add.reduceat(np.append(begins, False).astype(np.int64), ends[:-1]) * (np.diff(ends) > 0) if len(ends) > 1 else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inked = raw[ink]
    place = np.arange(len(inked)) - np.repeat(first, np.diff(np.append(first, len(inked))))
    h = common.mix64(np.add.reduceat(_BYTE[inked] * _PLACE[place & 1023], first))
    at = np.append(0, np.cumsum(n_words))
    full = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        full += h[k : k + len(full)] * _WORD[k]
    full = common.mix64(full)
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            parts.append(np.unique(full[a : b - words + 1]))
        else:
            parts.append(common.mix64((h[a:b] * _WORD[8 : 8 + b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else h[:0])
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def _points(docs: DataFrame, words: int, fold: bool) -> DataFrame:
    """(id, rk, set, n, sketch) of each document; set is null without shingles. rk names the id and the text."""

    def run(rows: pa.Table) -> pa.Table:
        x, at = shingles(common.column(rows, "text"), words, fold)
        n = np.diff(at)
        some = np.flatnonzero(n)
        sets, sketches = np.empty(len(n), object), np.empty(len(n), object)
        if len(some):
            starts = at[:-1][some]
            key = np.stack([np.add.reduceat(common.mix64(x ^ np.uint64(s)), starts) for s in (1, 2)], axis=1)
            low = np.stack([common.mix64(np.minimum.reduceat(x * m, starts)) for m in _MUL], axis=1).astype(np.uint16)
            for i, k, s in zip(some.tolist(), key, low, strict=True):
                sets[i], sketches[i] = k.tobytes(), s.tobytes()
        rows = rows.drop_columns(["text"])
        return rows.append_column("set", pa.array(sets, pa.binary())).append_column("n", pa.array(n, pa.int64())).append_column("sketch", pa.array(sketches, pa.binary()))

    kind = dict(docs.dtypes)["id"]
    return common.arrow_pass(docs.select("id", "rk", "text"), run, f"id {kind}, rk binary, set binary, n long, sketch binary")


def sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], schema: str) -> DataFrame:
    """``fn`` gets whole groups, many at a time: a table sorted by ``keys`` and the groups' row ranges.
    Groups must be bounded; many small ones share a batch, so that none costs a call."""
    common.bound_batches(df.sparkSession)

    def cuts(rows: pa.Table) -> list[int]:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            c = common.column(rows, k)
            new[1:] |= np.asarray(pa.compute.not_equal(c[1:], c[:-1]))
        return [*np.flatnonzero(new).tolist(), rows.num_rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        for last, batch in _with_last(batches):
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows == 0:
                continue
            at = cuts(rows)
            whole = at if last else at[:-1]
            if len(whole) > 1:
                yield from fn(rows, list(zip(whole[:-1], whole[1:], strict=True))).combine_chunks().to_batches()
            held = rows.slice(whole[-1]).to_batches()
        held, rows, batch = [], None, None
        common.give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _with_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    before = None
    for x in items:
        if before is not None:
            yield False, before
        before = x
    if before is not None:
        yield True, before


def forest(linked: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The first point of each point's component; ``linked(i, of)`` says to which of the points ``of`` i is
    linked. Only points that have no component yet are asked for, so a close group costs about one look at each."""
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        work = [first]
        while work and len(left):
            hit = linked(work.pop(), left)
            work += left[hit].tolist()
            root[left[hit]] = first
            left = left[~hit]
    return root


def forest_edges(keys: list[bytes], root: np.ndarray) -> list[tuple[bytes, bytes]]:
    return [(keys[r], keys[i]) for i, r in enumerate(root.tolist()) if r != i]


PAIR = "u binary, v binary"


def pair_table(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.binary()), "v": pa.array([p[1] for p in pairs], pa.binary())})


def _sketches(rows: pa.Table, name: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(common.column(rows, name).to_pylist()), np.uint16).reshape(rows.num_rows, COORDINATES)


def _likely(rows: pa.Table, groups: list[tuple[int, int]], least: float) -> pa.Table:
    keys, sketch = common.column(rows, "set").to_pylist(), _sketches(rows)
    pairs = []
    for a, b in groups:
        own = sketch[a:b]
        pairs += forest_edges(keys[a:b], forest(lambda i, of, s=own: (s[of] == s[i]).mean(axis=1) >= least, b - a))
    return pair_table(pairs)


def _children(points: DataFrame, level: int, threshold: float, roots: list[int] | None) -> DataFrame:
    """Paths of the points' buckets one or more levels on; ``roots`` are the runs, or each point brings its path."""
    pick = int((1 << 32) / (threshold * COORDINATES))
    index = np.arange(COORDINATES, dtype=np.uint64)

    def split(paths: np.ndarray, sketch: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = (common.mix64(paths[:, None] * np.uint64(0x9E3779B97F4A7C15) + index) >> np.uint64(32)) < pick
        r, c = np.nonzero(chosen)
        return common.mix64(common.mix64(paths[r] + index[c]) ^ sketch[who[r], c].astype(np.uint64)), who[r]

    def run(rows: pa.Table) -> pa.Table:
        sets, sketch = common.column(rows, "set"), _sketches(rows)
        if roots is None:
            paths, who = split(common.column(rows, "path").to_numpy().view(np.uint64), sketch, np.arange(len(sets)))
        else:
            paths, who = np.tile(common.mix64(np.array(roots, np.uint64)), len(sets)), np.repeat(np.arange(len(sets)), len(roots))
            for _ in range(level):
                paths, who = split(paths, sketch, who)
        return pa.table({"path": pa.array(paths.view(np.int64)), "set": sets.take(pa.array(who))})

    cols = ["set", "sketch"] + (["path"] if roots is None else [])
    return common.arrow_pass(points.select(*cols), run, "path long, set binary")


def recall(runs: int, level: int, threshold: float = THRESHOLD) -> float:
    """Probability that a pair at the threshold is in one bucket at ``level`` in some of ``runs`` runs."""
    agree = np.arange(COORDINATES + 1)
    weight = np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in agree.tolist()])
    survives = np.ones(len(agree))
    for _ in range(level):
        survives = 1 - (1 - survives / (threshold * COORDINATES)) ** agree
    return float(weight @ (1 - (1 - survives) ** runs))


def runs_at(level: int, runs: int = RUNS, threshold: float = THRESHOLD) -> int:
    """The least number of runs that find at ``level`` what ``runs`` find at level 2."""
    more = runs
    while recall(more, level, threshold) < recall(runs, 2, threshold):
        more += 1
    return more


def likely_pairs(points: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH, small: int = SMALL, slack: float = SLACK) -> DataFrame:
    """(u, v): a spanning forest of each bucket's likely pairs. ``points`` has distinct sets and their sketches."""
    # made anew for the counts and for the join, which costs less than to keep so many rows
    nodes = _children(points, 2, threshold, list(range(1, runs + 1)))
    sketches, least = points.select("set", "sketch"), threshold - slack
    pivot = F.min(F.struct(F.xxhash64("path", "set").alias("h"), "set"))["set"].alias("pivot")
    found = None
    for level in range(2, depth + 1):
        size = common.cut(nodes.groupBy("path").agg(F.count("*").alias("size"), pivot).where("size > 1"))
        if level == 2 and not size.where(F.col("size") > small).isEmpty():
            crowded = common.hot_join(nodes, size.where(F.col("size") > small), "path", "size", size.agg(F.sum("size").alias("n")).first()["n"])
            crowded = common.cut(crowded.select("set").distinct())
            nodes = nodes.unionByName(_children(crowded.join(sketches, "set"), 2, threshold, list(range(runs + 1, runs_at(depth, runs, threshold) + 1))))
            size = common.cut(nodes.groupBy("path").agg(F.count("*").alias("size"), pivot).where("size > 1"))
        few = nodes.join(size.where(F.col("size") <= small), "path").join(sketches, "set").select("path", "set", "sketch")
        pairs = sorted_groups(few, ["path"], lambda rows, groups: _likely(rows, groups, least), PAIR)
        found = pairs if found is None else found.unionByName(pairs)
        large = size.where(F.col("size") > small)
        if large.isEmpty():
            return found
        left = common.cut(_near_pivots(nodes, large, sketches, least))
        found = found.unionByName(left.where("near and set <> pivot").select(F.col("pivot").alias("u"), F.col("set").alias("v")))
        left = left.where("not near or set = pivot").select("path", "set")
        if level < depth:
            nodes = _children(left.join(sketches, "set"), 1, threshold, None)
    # still large: chunks of the bucket against each other
    half = max(1, small // 2)
    total = left.count()
    chunk = common.hot_join(left, left.groupBy("path").agg(F.count("*").alias("size")), "path", "size", total)
    chunk = chunk.withColumn("chunks", F.ceil(F.col("size") / half)).withColumn("mine", F.pmod(F.xxhash64("set"), F.col("chunks")))
    each = chunk.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    each = each.select("path", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "set").join(sketches, "set")
    return found.unionByName(sorted_groups(each, ["path", "i", "j"], lambda rows, groups: _likely(rows, groups, least), PAIR))


def _near_pivots(nodes: DataFrame, large: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(path, set, pivot, near) of the points in large buckets: is a point likely to be like its bucket's pivot?
    Such points are linked to the pivot, which alone goes on, so that a group of near copies,
    which no split would divide, shrinks to a few points. Pivots differ from bucket to bucket."""

    def run(rows: pa.Table) -> pa.Table:
        near = (_sketches(rows) == _sketches(rows, "other")).mean(axis=1) >= least
        return pa.table({**{c: rows.column(c) for c in ("path", "set", "pivot")}, "near": pa.array(near)})

    pivots = common.cut(large.join(sketches.select(F.col("set").alias("pivot"), F.col("sketch").alias("other")), "pivot"))
    total = large.agg(F.sum("size").alias("n")).first()["n"]
    rows = common.hot_join(nodes, pivots, "path", "size", total).join(sketches, "set")
    return common.arrow_pass(rows.select("path", "set", "pivot", "sketch", "other"), run, "path long, set binary, pivot binary, near boolean")


def _shrunk(pairs: DataFrame) -> DataFrame:
    """Each partition's pairs as stars around the least key of each of their components; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            path = []
            while (y := up.setdefault(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                up[p] = x
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        stars = [(r, x) for x in up if (r := top(x)) != x]
        for i in range(0, len(stars), 65536):
            yield from pair_table(stars[i : i + 65536]).to_batches()

    common.bound_batches(pairs.sparkSession)
    return pairs.select("u", "v").mapInArrow(run, PAIR)


def components(pairs: DataFrame) -> DataFrame:
    """(v, root) of every key in ``pairs`` (u, v): the least key it is connected to. Each round links the larger
    neighbours of every key to the least one, then its smaller neighbours; a key's neighbours are
    never listed, and those of a key with very many stay where they are (:func:`common.hot_join`)."""
    spark = pairs.sparkSession
    edges, old = common.store(_shrunk(pairs))
    while True:
        total = edges.count()
        ends = edges.select(F.col("u").alias("k"), F.col("v").alias("o"), F.lit(1).alias("up")).union(edges.select("v", "u", F.lit(0)))
        around = ends.groupBy("k").agg(F.min("o").alias("low"), F.max("o").alias("high"), F.max("up").alias("up"), F.min("up").alias("down"), F.sum("up").alias("above"), F.count("*").alias("rows"))
        around, path = common.store(around, 2 * total)
        # stars: no key is both a centre and a leaf, and a leaf has one centre
        if around.where("up <> down or (up = 0 and low <> high)").isEmpty():
            return around.select(F.col("k").alias("v"), F.when(F.col("up") == 1, F.col("k")).otherwise(F.col("low")).alias("root"))
        least = around.where("up = 1").select(F.col("k").alias("u"), F.least("k", "low").alias("m"), "above")
        large, middle = common.store(common.hot_join(edges, least, "u", "above", total).where("m <> v").select(F.col("m").alias("u"), "v"), total)
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("rows"))
        star = common.hot_join(large, low, "v", "rows", total)
        star = star.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v")
        edges, new = common.store(_shrunk(common.few(star.unionByName(least.where("m <> u").select(F.col("m").alias("u"), F.col("u").alias("v"))), 2 * total)))
        for gone in (old, path, middle):
            common.remove(spark, gone)
        old = new


def _exact(rows: pa.Table, groups: list[tuple[int, int]], threshold: float) -> list[tuple[bytes, int, bytes | None]]:
    """For each group of sets (key, links, None) of those with links, and (root, 0, key) of a forest of the links.

    A set's tokens may be its shingles, or its differences from another set r; then two sets have
    offset + offset + (common tokens) shingles in common, where a set's offset is what it shares with r less half of r.
    Where a group is two chunks, only links between them count."""
    keys, copies = common.column(rows, "set").to_pylist(), common.column(rows, "copies").to_numpy()
    blobs, mine = common.column(rows, "shingles").to_pylist(), common.column(rows, "mine").to_numpy()
    sizes, offsets = common.column(rows, "n").to_numpy(), common.column(rows, "offset").to_numpy()
    out: list[tuple[bytes, int, bytes | None]] = []
    for a, b in groups:
        n = b - a
        if n < 2:
            continue
        own = np.array([len(x) // 8 for x in blobs[a:b]])
        token, df = np.unique(np.frombuffer(b"".join(blobs[a:b]), np.uint64), return_inverse=True, return_counts=True)[1:]
        who = np.repeat(np.arange(n), own)
        often = df[token] > 1
        column = (np.cumsum(df > 1) - 1)[token[often]]
        who, width = who[often], 4096
        order = np.argsort(column, kind="stable")
        who, column = who[order], column[order]
        offset, size = offsets[a:b].astype(np.float32), sizes[a:b]
        common_to = offset[:, None] + offset[None, :]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            x, y = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((n, width), np.float32)
            part[who[x:y], column[x:y] - lo] = 1
            common_to += part @ part.T
        linked = np.zeros((n, n), bool)
        for lo in range(0, n, 128):
            both = common_to[lo : lo + 128]
            linked[lo : lo + 128] = both >= threshold * (size[lo : lo + 128, None] + size[None, :] - both) - 1e-6
        del common_to
        np.fill_diagonal(linked, False)
        if mine[a:b].min() < mine[a:b].max():
            linked &= mine[a:b, None] != mine[None, a:b]
        links = np.concatenate([linked[lo : lo + 128] @ copies[a:b].astype(np.float64) for lo in range(0, n, 128)])
        out += [(keys[a + i], int(x), None) for i, x in enumerate(links.tolist()) if x]
        out += [(r, 0, v) for r, v in forest_edges(keys[a:b], forest(lambda i, of, l=linked: l[i, of], n))]
    return out


_FOUND = "u binary, links long, v binary, root binary, set binary, n long, copies long, offset double, near boolean, shingles binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_KINDS = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.binary())


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(_NAMES, cols, _KINDS, strict=True)})


def _compared(rows: pa.Table, groups: list[tuple[int, int]], threshold: float) -> pa.Table:
    """Whole components: their links and forests. Of a part of a larger one: each set's differences from the component's
    root, and whether it is linked to that."""
    chunks = common.column(rows, "chunks").to_numpy()
    out = [(u, links, v, *[None] * 7) for u, links, v in _exact(rows, [g for g in groups if chunks[g[0]] == 1], threshold)]
    cols = ("set", "root", "n", "copies", "shingles", "again")
    for a, b in groups:
        if chunks[a] == 1:
            continue
        part = list(zip(*(common.column(rows, c).slice(a, b - a).to_pylist() for c in cols), strict=True))
        base = np.frombuffer(next(x[4] for x in part if x[0] == x[1]), np.uint64)
        for key, root, n, copies, blob, again in part:
            if not again:
                own = np.frombuffer(blob, np.uint64)
                apart = np.setxor1d(own, base, assume_unique=True)
                both = (len(own) + len(base) - len(apart)) // 2
                near = both >= threshold * (len(own) + len(base) - both) - 1e-6
                out.append((None, None, None, root, key, n, copies, both - len(base) / 2, near, apart.tobytes()))
    return _found(out)


def _shingled(docs: DataFrame, words: int, fold: bool) -> DataFrame:
    """``docs`` with shingles for their text."""

    def run(rows: pa.Table) -> pa.Table:
        x, at = shingles(common.column(rows, "text"), words, fold)
        blobs = [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return rows.drop_columns(["text"]).append_column("shingles", pa.array(blobs, pa.binary()))

    kept = [f"{c} {k}" for c, k in docs.dtypes if c != "text"]
    return common.arrow_pass(docs.select(*(c for c in docs.columns if c != "text"), "text"), run, ", ".join([*kept, "shingles binary"]))


def _row_key(id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("none")).cast("binary"), F.lit(b"|"), F.unhex(F.md5(F.coalesce(text, F.lit("")))))))


def named_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), _row_key(F.col(id), F.col(text)).alias("rk"))


def _grid(rows: DataFrame, sums: DataFrame, total: int) -> DataFrame:
    """``rows`` of components dealt to pairs of chunks (root, i, j); ``sums`` has root, sets, chunks and settled: what is near
    the root fills the first ``settled`` chunks, which aren't compared with each other."""
    each = common.hot_join(rows, sums, "root", "sets", total)
    first = F.col("near") & (F.col("settled") > 0)
    mine = F.when(first, F.pmod(F.xxhash64("set"), F.col("settled"))).otherwise(F.col("settled") + F.pmod(F.xxhash64("set"), F.col("chunks") - F.col("settled")))
    begin = F.when(first, F.col("settled")).otherwise(F.lit(0).cast("long"))
    each = each.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(begin, F.col("chunks") - 1)))
    return each.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "set", "n", "copies", "offset", "shingles")


def _chunks(tokens: Column, sets: Column, most_tokens: int, most_sets: int) -> Column:
    return F.greatest(F.ceil(tokens / most_tokens), F.ceil(sets / most_sets), F.lit(1)).cast("long")


def classes_of(docs: DataFrame, words: int, threshold: float, links: bool, fold: bool = False, pairs: Callable[..., DataFrame] = likely_pairs, **how) -> tuple[DataFrame, DataFrame, int]:
    """(id, rk, set, n) of each document; (set, class, first, links, copies) of each set: the class's least
    (id, rk), a set's links to other sets (if asked for), and its own copies; the number of documents."""
    points = common.cut(_points(docs, words, fold))
    total = points.count()
    order = F.struct(F.col("id").isNull().alias("null"), "id", "rk")
    sets = common.cut(points.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), total)
    near = common.cut(components(pairs(sets, threshold, **how)).withColumnRenamed("v", "set").join(sets.select("set", "n", "copies", F.col("first.rk").alias("rk")), "set"), total)
    size = near.groupBy("root").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    size = common.cut(size.withColumn("chunks", _chunks(F.col("shingles"), F.col("sets"), CHUNK_SHINGLES, CHUNK_SETS)), total)
    members = common.hot_join(near, size, "root", "sets", near.count())
    # one text of each set, dealt by id and text, so that copies don't meet; of repeated rows one
    texts = docs.select("rk", "text").join(members, "rk").dropDuplicates(["rk"])
    part = F.pmod(F.xxhash64("set"), F.col("chunks"))
    parts = F.when(F.col("set") == F.col("root"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(part))
    whole = _shingled(texts.select("set", "root", "n", "copies", "chunks", "text"), words, fold).withColumn("part", F.explode(parts))
    whole = whole.withColumns({"again": F.col("part") != part, "mine": F.lit(0), "offset": F.lit(0.0)})
    exact = common.cut(sorted_groups(whole, ["root", "part"], lambda rows, groups: _compared(rows, groups, threshold), _FOUND))
    count = exact.where("u is not null and v is null").select(F.col("u").alias("set"), "links")
    label = exact.where("v is not null").select(F.col("v").alias("set"), F.col("u").alias("root"))
    apart = exact.where("shingles is not null").select("root", "set", "n", "copies", "offset", "near", "shingles")
    if not apart.isEmpty():
        tokens = F.octet_length("shingles") / 8
        near = F.col("near")
        sums = apart.groupBy("root").agg(F.count("*").alias("sets"), F.bool_and("near").alias("near"), F.sum(tokens).alias("tokens"), F.count_if(near).alias("sets_near"), F.sum(F.when(near, tokens).otherwise(0)).alias("tokens_near"))
        if links:
            sums = sums.withColumn("chunks", _chunks(F.col("tokens"), F.col("sets"), CHUNK_DIFFERENCES, CHUNK_SHORT)).withColumn("settled", F.lit(0).cast("long"))
        else:
            settled = _chunks(F.col("tokens_near"), F.col("sets_near"), CHUNK_DIFFERENCES, CHUNK_SHORT)
            rest = _chunks(F.col("tokens") - F.col("tokens_near"), F.col("sets") - F.col("sets_near"), CHUNK_DIFFERENCES, CHUNK_SHORT)
            sums = sums.withColumn("settled", settled).withColumn("chunks", settled + rest)
        sums = common.cut(sums.drop("tokens", "sets_near", "tokens_near"), total)
        # where every set is linked to the root, the class is known
        open = sums if links else sums.where("not near")
        some = sorted_groups(_grid(apart, open.select("root", "sets", "chunks", "settled"), apart.count()), ["root", "i", "j"], lambda rows, groups: _found([(*x, *[None] * 7) for x in _exact(rows, groups, threshold)]), _FOUND)
        some = common.cut(some.select("u", "links", "v"))
        count = count.unionByName(some.where("v is null").groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("links")))
        found = some.where("v is not null").select("u", "v")
        if not links:
            found = found.unionByName(apart.where("near and set <> root").select(F.col("root").alias("u"), F.col("set").alias("v")))
        stars = components(found).where("v <> root").select(F.col("v").alias("set"), "root")
        label = label.unionByName(stars)
    label = common.cut(label, total)
    own = sets.select("set", "copies", "first")
    named = label.unionByName(label.select(F.col("root").alias("set"), "root").distinct()).join(own, "set")
    first = common.cut(named.groupBy("root").agg(F.min("first").alias("class"), F.count("*").alias("rows")), total)
    named = common.hot_join(common.cut(named.select("set", "root"), total), first, "root", "rows", label.count()).select("set", "class")
    classes = own.join(named, "set", "left").withColumn("class", F.coalesce("class", "first"))
    if links:
        classes = classes.join(count, "set", "left")
    return points.select("id", "rk", "set", "n"), common.cut(classes, total), total


def join_near(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per document: id, class_id (the least id it is linked to, over links of links), n_links
    (other documents at least ``threshold`` similar to it)."""
    points, classes, total = classes_of(named_rows(docs, id, text), words, threshold, True, **how)
    got = common.hot_join(points.where("set is not null"), classes, "set", "copies", total)
    got = got.select("id", F.col("class.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    alone = points.where("set is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return got.unionByName(alone).withColumnRenamed("id", id)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of an earlier one: of each class the
    document with the least id stays; of rows with that id and text, one. Texts without shingles all stay,
    equal rows of them once."""
    points, classes, total = classes_of(named_rows(docs, id, text), words, threshold, False, **how)
    kept = classes.where("class.rk = first.rk").select(F.col("first.rk").alias("rk"))
    kept = common.cut(kept.unionByName(points.where("set is null").select("rk").distinct()), total)
    row = "__row_key"
    while row in docs.columns:
        row += "_"
    keyed = docs.select(*docs.columns, _row_key(F.col(id), F.col(text)).alias(row))
    # the join deals texts out by the key already, so finding equal rows needs no second shuffle
    one = W.partitionBy(row).orderBy(row)
    return keyed.join(kept.withColumnRenamed("rk", row), row).withColumn(row + "n", F.row_number().over(one)).where(F.col(row + "n") == 1).select(*docs.columns)
