"""The best k of a corpus for each of a stated set of queries, exactly: by shared terms and by inner product.

**Terms.** Documents are dealt into blocks of about ``DOCS`` by a hash, so a term's postings lie in blocks too, however common
it is, and each (term, block) has a largest score. A query's sum of these over its terms bounds every document of a
block. The few blocks with the highest bounds are scored first; the k-th best score there is the least that a document must reach,
so only blocks whose bound reaches it are scored. What is left out can't be among the best k.

**Vectors.** Queries and corpus are packed into blocks of rows. Each corpus batch is multiplied with each query block by one
matrix product; a task keeps the best k of each query while it goes, with their ids, and the tasks' lists are merged in groups, then
as a whole. Query blocks travel by broadcasts of at most ``BROADCAST`` bytes, as many as it takes. A product only says which rows may be among the best; their
scores are summed anew in the order of the dimensions, so that equal vectors tie, and ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.operators.segments import array
from harrow.sources.tables import cut

DOCS, FIRST, FAN = 64, 4, 64
QUERY_BLOCK, BROADCAST = 1024, 64 << 20


def bm25(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, id: str = "id", text: str = "text", docs: int = DOCS, first: int = FIRST) -> DataFrame:
    """(query, id, score, rank) by BM25 over lower-case white-space terms, of documents that share a term with the query; ties in
    the first nine decimals by id."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    rows = corpus.select(F.col(id).alias("id"), words.alias("w")).where(F.size("w") > 0)
    rows = rows.withColumns({"len": F.size("w"), "term": F.explode("w")}).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    asked = cut(queries.select(F.col(id).alias("query"), F.explode(F.array_distinct(words)).alias("term")).distinct())
    lengths = corpus.select(F.size(words).alias("n")).where("n > 0").agg(F.avg("n").alias("avg"), F.count("*").alias("n")).first()
    n, avg = lengths["n"], lengths["avg"] or 1.0
    terms = asked.select("term").distinct()
    tf = rows.join(terms, "term", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, n // docs))))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg))
    tf = cut(tf.select("term", "block", "id", part.alias("part")))
    # by term and block, so that a common term's postings are many groups
    most = tf.groupBy("term", "block").agg(F.max("part").alias("part"), F.count("*").alias("df"))
    idf = most.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = cut(asked.join(idf, "term"))
    bounds = cut(asked.join(most.select("term", "block", "part"), "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("part")).alias("bound")))

    def scored(blocks: DataFrame) -> DataFrame:
        wanted = blocks.select("query", "block").join(asked, "query")
        return wanted.join(tf, ["term", "block"]).groupBy("query", "id").agg(F.sum(F.col("idf") * F.col("part")).alias("score"))

    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "block"))
    best = scored(bounds.withColumn("nth", nth).where(F.col("nth") <= first).drop("nth"))
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    least = best.withColumn("nth", nth).where(F.col("nth") == k).select("query", F.col("score").alias("least"))
    reach = bounds.join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored(reach).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _packed(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """(ids, v): blocks of at most ``size`` rows; rows without a vector have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = pa.Table.from_batches([batch.slice(a, size)]).combine_chunks()
                lists = array(part, "v")
                yield pa.RecordBatch.from_arrays([pa.array([array(part, "id").to_pylist()], pa.list_(part.schema.field("id").type)), pa.array([lists.flatten().to_numpy().astype(np.float64).tobytes()])], ["ids", "v"])

    return rows.mapInArrow(run, f"ids array<{kind}>, v binary")


def _sums(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first dimension to the last."""
    out = np.zeros(len(c))
    for x, y in zip(c.T, q.T, strict=True):
        out += x * y
    return out


def _best(ids: list, scores: np.ndarray, k: int) -> list[int]:
    if len(ids) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(ids))
    return sorted(keep.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, id: str = "id", vector: str = "v", query_block: int = QUERY_BLOCK, most: int = BROADCAST) -> DataFrame:
    """(query, id, score, rank): the ``k`` rows with the largest inner product, ties by id. All vectors have one length and no nulls; rows
    without a vector or an id are neither asked nor found."""
    kind = dict(corpus.dtypes)[id]
    clean = lambda df: df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = clean(queries)
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0)).alias("b"), F.max(F.size("v")).alias("d")).first()
    d, rounds = size["d"] or 1, -(-size["b"] // most) or 1
    blocks = cut(_packed(asked.repartition(max(1, size["b"] // (8 * d * query_block)), "id"), dict(queries.dtypes)[id], query_block).select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("queries"), F.col("v").alias("q")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                c, q, ids = np.frombuffer(r["v"]).reshape(-1, d), np.frombuffer(r["q"]).reshape(-1, d), r["ids"]
                names, lists = held.setdefault(r["block"], (r["queries"], [([], np.zeros(0))] * len(r["queries"])))
                products = q @ c.T
                slack = 1e-12 * d * (np.abs(q).max(axis=1, initial=0) * np.abs(c).max(initial=0) + 1)
                for j in range(len(names)):
                    row, (own, scores) = products[j], lists[j]
                    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                    if len(own) == k:
                        least = max(least, scores[-1])
                    maybe = np.flatnonzero(row >= least - slack[j])
                    if len(maybe):
                        own = own + [ids[i] for i in maybe.tolist()]
                        scores = np.append(scores, _sums(c[maybe], np.broadcast_to(q[j], (len(maybe), d))))
                        kept = _best(own, scores, k)
                        lists[j] = ([own[i] for i in kept], scores[kept])
        for names, lists in held.values():
            flat = [(name, i, float(s)) for name, (own, scores) in zip(names, lists, strict=True) for i, s in zip(own, scores, strict=True)]
            for a in range(0, len(flat), 65536):
                part = list(zip(*flat[a : a + 65536], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.float64())], ["query", "id", "score"])

    packed = _packed(clean(corpus), kind, 4096)
    found = None
    for i in range(rounds):
        some = blocks if rounds == 1 else blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == i)
        # a stated query set against all rows, block by block
        got = packed.crossJoin(F.broadcast(some)).mapInArrow(run, f"query {dict(queries.dtypes)[id]}, id {kind}, score double")
        got = got.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
        found = got if found is None else found.unionByName(got)
    order = [F.desc("score"), F.asc("id")]
    merged = found.withColumn("r", F.row_number().over(W.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k)
    return merged.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order)).cast("long")).where(F.col("rank") <= k).select("query", "id", "score", "rank")
