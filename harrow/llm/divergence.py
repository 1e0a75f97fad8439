"""How sources differ in their words, by products of one-hot level columns.

Each language keeps the terms that stand in enough of its documents. A (language, source) group gives a term a price that
depends only on how often it has it, its count level. So with an indicator column for each (group, level), whose rows are the
terms, the product of these columns with their transpose is the joint table of every two groups: how many terms have level i in
one and level j in the other. Pricing a joint table (cells times the difference of two prices) gives the distance of two
groups. The product is taken in blocks of terms, and within a block in strips of columns; its entries are at most the block's
number of terms, so float32 products are exact, and distances are sums of 64-bit integers. A price's own arithmetic is decimal.

Documents become (group, term, count) rows where they are, combined in a worker, then by Spark before and after a shuffle by (group, term).
A term's groups then meet by (language, term). A block gets the terms of a hash and one row of each group of its language, so a block is
bounded unless a language has very many sources, whose pairs are the result anyhow. Prices of hot groups come by a bounded broadcast.
The best terms of a group are cut in each partition before they are ranked.

Defined results: null texts, languages and sources are ''; a text without terms leaves its group with a row, and a
language without kept terms has distances of 0; repeated rows are documents of their own; ties go by the item's bytes;
an empty table gives an empty result; other columns aren't read. Long texts are counted in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: A term stands in this many documents of its language at least; added to each count; prices of a group add up to about this; ranks of terms.
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: (term, group) cells of a block about, and its most terms; columns of a strip; distinct terms that a worker holds; bytes of a piece.
CELLS, MOST_TERMS, STRIP, HELD, PIECE = 1 << 14, 4096, 2048, 400_000, 4 << 20
#: Each byte of a term in lower case, any other as a space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _pieces(folded: bytes, a: int, b: int) -> Iterator[list[bytes]]:
    while b - a > PIECE and (z := folded.find(b" ", a + PIECE, b)) >= 0:
        yield folded[a:z].split()
        a = z
    yield folded[a:b].split()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often a group has a term and in how many documents; a group itself has a null term."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def table() -> Iterator[pa.RecordBatch]:
            for (l, s), (times, within) in held.items():
                terms = [None, *times]
                cols = [pa.array([l] * len(terms)), pa.array([s] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([0, *times.values()], pa.int64()), pa.array([0, *(within[t] for t in times)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            rows = pa.Table.from_batches([batch]).combine_chunks()
            raw, at = common.utf8(common.column(rows, "text"))
            folded = raw.tobytes().translate(_FOLD)
            for l, s, a, b in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                times, within = held.setdefault((l, s), (Counter(), Counter()))
                own: set[bytes] = set()
                for words in _pieces(folded, a, b):
                    times.update(words)
                    own.update(words)
                within.update(own)
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield from table()
        yield from table()

    cols = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    parts = docs.select(*cols).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH terms)), exactly."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    down = (total + SMOOTH * terms).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, F.nullif(down, F.lit(0).cast("decimal(20,0)")))


def _one_hot(n_terms: int, term: np.ndarray, level: np.ndarray, groups: list[tuple[int, int, int]], width: int) -> np.ndarray:
    """Indicator columns of some groups; each has (first entry, last, its first column), and ``level`` counts from that.
    Level 0 is that of terms which a group lacks."""
    hot = np.zeros((n_terms, width), np.float32)
    for a, b, first in groups:
        hot[:, first] = 1
        hot[term[a:b], first] = 0
        hot[term[a:b], first + level[a:b]] = 1
    return hot


def joint_prices(term: np.ndarray, group: np.ndarray, n: np.ndarray, p: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Sum over all terms of |p - q| for every two groups. The entries (term, group, n, p) are sorted by group; a term that a group
    lacks costs ``zero`` there. Terms and groups are numbered from 0, and every term has an entry."""
    n_groups, n_terms = len(zero), int(term.max()) + 1 if len(term) else 0
    at = np.searchsorted(group, np.arange(n_groups + 1))
    level, costs = np.zeros(len(n), np.int64), []
    for g, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        _, one, which = np.unique(n[a:b], return_index=True, return_inverse=True)
        level[a:b] = which + 1
        costs.append(np.append(zero[g], p[a:b][one]).astype(np.int64))
    strips: list[list[int]] = []
    used = STRIP
    for g, c in enumerate(costs):
        if used + len(c) > STRIP:
            strips.append([])
            used = 0
        strips[-1].append(g)
        used += len(c)
    out = np.zeros((n_groups, n_groups), np.int64)
    if not n_terms:
        return out

    def columns(strip: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.append(0, np.cumsum([len(costs[g]) for g in strip]))
        hot = _one_hot(n_terms, term, level, [(at[g], at[g + 1], f) for g, f in zip(strip, first.tolist(), strict=False)], int(first[-1]))
        return hot, np.concatenate([costs[g] for g in strip]), first[:-1]

    for i, x in enumerate(strips):
        left, cost, begins = columns(x)
        for y in strips[i:]:
            right, other, starts = columns(y)
            joint = (left.T @ right).astype(np.int64)
            joint *= np.abs(cost[:, None] - other[None, :])
            sums = np.add.reduceat(np.add.reduceat(joint, begins, axis=0), starts, axis=1)
            out[np.ix_(x, y)] = sums
            out[np.ix_(y, x)] = sums.T
    return out


_PAIRS = "lang string, source string, item string, value long"


def _priced(rows: pa.Table) -> pa.Table:
    """The distances of a block's groups. Rows: its groups (a null term), and their counts of its terms."""
    rows = rows.sort_by([("source", "ascending")]).combine_chunks()
    some = rows.column("term").is_valid()
    own = rows.filter(some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some)
    groups = rows.filter(rows.column("term").is_null())
    names = groups.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    group = np.array([place[s] for s in own.column("source").to_pylist()], np.int64)
    order = np.argsort(group, kind="stable")
    term = common.column(own, "term").dictionary_encode().indices.to_numpy().astype(np.int64)
    n, p = common.column(own, "n").to_numpy(), common.column(own, "p").to_numpy()
    zero = common.column(groups, "p").fill_null(0).to_numpy()
    value = joint_prices(term[order], group[order], n[order], p[order], zero)
    i, j = np.triu_indices(len(names), 1)
    lang = rows.column("lang")[0].as_py() if rows.num_rows else None
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array(names, pa.string()).take(pa.array(i)), "item": pa.array(names, pa.string()).take(pa.array(j)), "value": pa.array(value[i, j])})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the distance to each other source of the language; part ``term``: the
    ``top`` terms whose price is most above that in the whole language."""
    all_rows = common.cut(counts(docs, text, lang, source))
    together, by_source = W.partitionBy("lang", "term"), W.partitionBy("lang", "term").orderBy("source")
    rows = all_rows.where("term is not null").withColumns({"docs": F.sum("docs").over(together), "all": F.sum("n").over(together), "nth": F.row_number().over(by_source)})
    rows = common.cut(rows.where(F.col("docs") >= least_docs).drop("docs"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    langs = rows.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("nth") == 1).alias("terms"))
    groups = all_rows.where("term is null").select("lang", "source")
    beside = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(langs, "lang", "left")
    groups = groups.join(own, ["lang", "source"], "left").join(beside, "lang").fillna(0, ["total", "rows", "lang_total", "terms"])
    per_block = F.least(F.lit(MOST_TERMS), F.greatest(F.col("groups"), F.ceil(CELLS / F.col("groups"))))
    groups = common.cut(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / per_block)).cast("long")))
    n_rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    priced = common.hot_join(rows, groups, ["lang", "source"], "rows", n_rows).withColumn("p", price("n", "total", "terms"))
    empty = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), price(F.lit(0), "total", "terms").alias("p"))
    blocks = priced.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "p").unionByName(empty)
    pairs = blocks.groupBy("lang", "block").applyInArrow(_priced, _PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = common.cut(pairs)
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    q = price("all", "lang_total", "terms")
    terms = priced.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    best = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", best)
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", best).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
