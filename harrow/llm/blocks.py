"""Questions between blocks of documents and buckets of keys.

Documents are dealt into blocks of a few MB. A block sends each bucket the distinct keys that it
has there, once however often its documents hold them; the bucket sees all blocks' keys and sends each
block one answer per key, in the order asked. So a key that a third of all documents hold costs one
entry per block, and no task sees more than a block or a bucket. The blocks' shuffle is the same in
each pass, and Spark reuses it. Both numbers grow with the input: blocks of ``BLOCK_BYTES`` at 1 GB of text,
larger by the square root of the input up to ``MOST_BLOCK_BYTES``, so that the rows (block, bucket)
stay few. Where a question needs no text afterwards (:func:`ask_in_place`), the blocks are stretches of the input's
own partitions and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 4 << 20
MOST_BLOCK_BYTES = 16 << 20
#: What blocks and buckets send each other; the payloads' meaning is the sender's.
LETTER = "block long, bucket long, a binary, b binary, c binary"


def sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Bytes of a block, and the number of buckets."""
    total = common.text_bytes(docs, text)
    size = min(MOST_BLOCK_BYTES, int(BLOCK_BYTES * max(1.0, total / 1e9) ** 0.5))
    return size, max(common.partitions(docs.sparkSession), -(-total // size))


def ask_in_place(docs: DataFrame, id: str, text: str, size: int, fn: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Letters of blocks of about ``size`` bytes, made where the rows (id, text) are. A block is named by its place
    and content, so that one that is made anew from rows in another order is another block, which lacks answers."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        held, n, seed = [], 0, TaskContext.get().partitionId() << 24

        def asked() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            name = xxhash.xxh3_64(seed=seed)
            for column in rows.columns:
                for buffer in common.column(pa.table([column], ["c"]), "c").buffers():
                    name.update(buffer or b"")
            yield from fn(name.intdigest() >> 1, rows).to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n >= size:
                yield from asked()
                held, n, seed = [], 0, seed + 1
        if held and n:
            yield from asked()

    return docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, LETTER)


def blocked(docs: DataFrame, id: str, text: str, alike: int) -> tuple[DataFrame, int]:
    """(block, data) with all ids and texts, packed and compressed by block before they are shuffled, and the number
    of blocks. A null text is empty. Copies of a text of at least ``alike`` bytes come to one block, and a part of the data has a text
    once, with the list of its ids; so a block holds some bytes for each copy beside one text."""
    _, n = sizes(docs, text)
    apart = F.when(F.coalesce(F.octet_length(text), F.lit(0)) < alike, F.col(id))
    rows = docs.select(F.pmod(F.xxhash64(F.col(text), apart), F.lit(n)).alias("block"), F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def pack(rows: pa.Table) -> pa.Table:
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        order, own, first = by_bucket(common.column(rows, "block").to_numpy())
        rows = rows.drop_columns(["block"]).take(pa.array(order)).combine_chunks()
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            part, sink = rows.slice(a, b - a).group_by("text", use_threads=False).aggregate([("id", "list")]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=how) as w:
                w.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        return pa.table({"block": pa.array(own), "data": pa.array(out, pa.binary())})

    return common.arrow_pass(rows, pack, "block long, data binary"), n


@dataclass
class Block:
    """The distinct texts of a block, in no order that counts, and of each of its rows the id and which text it has."""

    texts: pa.Array
    ids: pa.Array
    text_of: np.ndarray


def _unpacked(rows: pa.Table) -> Block:
    whole = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows.column("data"))
    texts, ids = common.column(whole, "text").dictionary_encode(), common.column(whole, "id_list")
    return Block(texts.dictionary, ids.flatten(), np.repeat(texts.indices.to_numpy(), ids.value_lengths().to_numpy()))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def letters(rows: list[tuple[int, int, bytes | None, bytes | None, bytes | None]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()), **{k: pa.array(cols[i], pa.binary()) for i, k in ((2, "a"), (3, "b"), (4, "c"))}})


def ask(docs: DataFrame, fn: Callable[[int, Block], pa.Table]) -> DataFrame:
    """Letters of each block of ``docs``."""
    return docs.groupBy("block").applyInArrow(lambda key, rows: fn(key[0].as_py(), _unpacked(rows)), LETTER)


def ask_again(docs: DataFrame, answers: DataFrame, fn: Callable[[int, Block, dict], pa.Table], schema: str = LETTER) -> DataFrame:
    """What ``fn`` makes of each block and its answers, a dict by (sign of the bucket, bucket)."""

    def both(key, rows: pa.Table, got: pa.Table) -> pa.Table:
        by = {r["bucket"]: (r["a"], r["b"], r["c"]) for r in got.to_pylist()}
        return fn(key[0].as_py(), _unpacked(rows), by)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def answer(questions: DataFrame, fn: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """``fn`` gets all letters of a bucket, ordered by block, and returns letters."""

    def run(rows: pa.Table) -> pa.Table:
        return letters(fn(sorted(rows.to_pylist(), key=lambda r: r["block"])))

    return questions.groupBy("bucket").applyInArrow(run, LETTER)


def gather(letters: DataFrame, fn: Callable[[int, dict], pa.Table], schema: str) -> DataFrame:
    """What ``fn`` makes of each block's letters, a dict by bucket."""

    return letters.groupBy("block").applyInArrow(lambda key, rows: fn(key[0].as_py(), {r["bucket"]: (r["a"], r["b"], r["c"]) for r in rows.to_pylist()}), schema)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, the buckets that occur, and where each begins in that order."""
    order = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[order], return_index=True)
    return order, own, np.append(first, len(bucket))
