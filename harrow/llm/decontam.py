"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and test items are brought to the form " word word ... word "; every ten consecutive words of
an item are a pattern. A shift table over the patterns' blocks of bytes says how far the search
may skip; a shift of zero leads to the bucket of patterns whose searched part ends in that block,
and a direct comparison confirms an occurrence. The search runs in NumPy over many stretches of a
batch at once. The test set is written to the shared folder in blocks of ``PATTERN_BYTES`` of patterns at most and
each task loads a block there; a larger set takes more passes over the documents, without a shuffle. The driver
holds no item and nothing is broadcast.

Defined results: a null text, or one without words, has no words and no hits; an item without words
is never found; an item without an id counts as one named by the empty string; equal windows of several items count for each; repeated rows are each judged alike;
empty tables give empty results or no hits. Columns of the documents are passed through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .warc import open_store

WINDOW = 10
PATTERN_BYTES = 16 << 20
_LANE = 4096
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class WuManber:
    """Search for byte patterns that are at least ``block`` long."""

    def __init__(self, patterns: list[bytes], block: int, bits: int = 20):
        self.patterns, self.block, self.bits = patterns, block, bits
        self.m = m = min(map(len, patterns))
        heads = np.frombuffer(b"".join(p[:m].ljust(m + 8, b"\0") for p in patterns), np.uint8).reshape(len(patterns), m + 8)
        self.shift = np.full(1 << bits, m - block + 1, np.int64)
        for end in range(block, m + 1):  # the later an end, the smaller its shift
            self.shift[self._hash(heads[:, end - block : end - block + 8].copy().view("<u8")[:, 0])] = m - end
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(self._hash(heads[:, m - block : m - block + 8].copy().view("<u8")[:, 0])):
            self.buckets[int(h)].append(i)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        x = x & np.uint64((1 << 8 * self.block) - 1)
        return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of all occurrences in ``text``."""
        last = len(text) - self.m
        if last < 0:
            return []
        eight = np.ndarray(len(text), "<u8", text + bytes(8), 0, (1,))
        at = np.arange(0, last + 1, _LANE)
        ends = np.minimum(at + _LANE, last + 1)
        found = []
        while len(at):
            h = self._hash(eight[at + (self.m - self.block)])
            step = self.shift[h]
            for start, bucket in zip(at[step == 0].tolist(), h[step == 0].tolist(), strict=True):
                found += [(start, i) for i in self.buckets.get(bucket, ()) if text.startswith(self.patterns[i], start)]
            at = at + np.maximum(step, 1)
            inside = at < ends
            at, ends = at[inside], ends[inside]
        return found


class _Items:
    def __init__(self, items: list[tuple[str, str]]):
        self.owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                self.owners[b" " + b" ".join(words[i : i + WINDOW]) + b" "].add(item)
        self.searches = []
        for short in (True, False):  # short patterns get a table of their own, as they limit every skip
            if own := sorted(p for p in self.owners if (len(p) < 16) == short):
                self.searches.append(WuManber(own, 3 if short else 8))


_HELD: dict[tuple[str, int], _Items] = {}


def _loaded(folder: str, block: int) -> _Items:
    """A block of the test set from the shared folder, held by the worker."""
    if (folder, block) not in _HELD:
        from pyarrow import dataset

        store, path = open_store(folder)
        got = dataset.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=False, schema=pa.schema([("i", pa.string()), ("t", pa.string()), ("b", pa.int32())]))
        rows = got.to_table(filter=dataset.field("b") == block)
        _HELD.clear()
        _HELD[folder, block] = _Items(list(zip(rows.column("i").to_pylist(), rows.column("t").to_pylist(), strict=True)))
    return _HELD[folder, block]


def _search(docs: DataFrame, folder: str, block: int, text: str, own: str) -> DataFrame:
    """Adds the starts and lengths of hits (in words) and the items found to those of earlier blocks."""
    schema = docs.schema

    def run(rows: pa.Table) -> pa.Table:
        held = _loaded(folder, block)
        split = [words_of(t) for t in common.column(rows, text).to_pylist()]
        lines = [b" " + b" ".join(w) + b" " for w in split]
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
        whole = b"\n".join(lines)
        spots: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for search in held.searches:
            if hits := search.find(whole):
                for d, (at, i) in zip(np.searchsorted(starts, [a for a, _ in hits], "right") - 1, hits, strict=True):
                    spots[int(d)].append((at - int(starts[d]), search.patterns[i]))
        runs, found = common.column(rows, own + "runs").to_pylist(), common.column(rows, own + "items").to_pylist()
        for d, hit in spots.items():
            spaces = np.flatnonzero(np.frombuffer(lines[d], np.uint8) == 32)
            first = np.searchsorted(spaces, [a for a, _ in hit]).tolist()
            runs[d] = runs[d] + [x for f, (_, p) in zip(first, hit, strict=True) for x in (f, f + p.count(b" ") - 1)]
            found[d] = sorted({*found[d], *(o for _, p in hit for o in held.owners[p])})
        return common.with_columns(rows, **{own + "n": (pa.int64(), [len(w) for w in split]), own + "runs": (pa.list_(pa.int64()), runs), own + "items": (pa.list_(pa.string()), found)})

    return common.arrow_pass(docs, run, schema)


def _marked(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> tuple[DataFrame, str]:
    """``docs`` with words, hits and items in columns whose names begin with a prefix of their own."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = 1 + WINDOW * common.text_bytes(items, "t") // PATTERN_BYTES  # each word is in ten windows
    _, folder = common.store(items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")).repartition(min(blocks, common.partitions(docs.sparkSession)), "b"))
    own = "__"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    out = docs.withColumns({own + "n": F.lit(0).cast("long"), own + "runs": F.array().cast("array<bigint>"), own + "items": F.array().cast("array<string>")})
    for b in range(blocks):
        out = _search(out, folder, b, text, own)
    return out, own


def find_items(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked, own = _marked(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), benchmark, "text", item_id, item_text)

    def count(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        for n, runs, items in zip(*(common.column(rows, c).to_pylist() for c in (own + "n", own + "runs", own + "items")), strict=True):
            hit = np.zeros(n + 1 if runs else 1, np.int64)
            np.add.at(hit, runs[::2], 1)
            np.add.at(hit, runs[1::2], -1)
            hits = int((np.cumsum(hit) > 0).sum())
            for k, v in zip(out, (n, hits, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hits > 0), strict=True):
                out[k].append(v)
        return pa.table({id: rows.column("id"), **out})

    kind = dict(docs.dtypes)[id]
    return common.arrow_pass(marked.drop("text"), count, f"{id} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item."""
    marked, own = _marked(docs, benchmark, text, item_id, item_text)
    return marked.where(F.size(own + "items") == 0).select(*docs.columns)
