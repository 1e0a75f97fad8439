"""Helpers shared by the text operators: Arrow passes over documents and UTF-8 views of columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.session import ship

#: A batch that enters a Python worker holds this many bytes of rows at most (or one row).
BATCH_BYTES = 8 << 20
#: One word: what stands between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that very long texts cannot fill a worker; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def give_back() -> None:
    """Returns to the system what the functions of a worker's last task held: a worker is used again, that lies in
    cycles, and the allocators keep what is freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_pass(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Map each Arrow batch of ``df`` to a table with the columns of ``schema``; no shuffle."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(pa.Table.from_batches([batch])).combine_chunks().to_batches()
        batch = None
        give_back()

    return df.mapInArrow(run, schema)


def with_columns(rows: pa.Table, **cols: tuple[pa.DataType, list]) -> pa.Table:
    """``rows`` and new columns; one of the same name is replaced."""
    for name, (kind, values) in cols.items():
        array = pa.array(values, type=kind)
        at = rows.schema.get_field_index(name)
        rows = rows.set_column(at, name, array) if at >= 0 else rows.append_column(name, array)
    return rows


def column(rows: pa.Table, name: str) -> pa.Array:
    c = rows.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 offsets into it; a null is empty."""
    large = texts.fill_null("").cast(pa.large_string())
    if len(large) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="harrow-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Rows that a task of a stored table may get before there are more tasks than cores.
STORED_ROWS = 1 << 16


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows are worth, if it has more: a file costs a task more than a few rows do."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // STORED_ROWS)))


def store(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """``df`` written as a table to the shared folder and read back, and the table's place: lineage ends
    here, and lost executors cost nothing. ``rows`` is about how many rows it is made of, where that is known."""
    if rows is not None:
        df = few(df, rows)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    return store(df, rows)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: A key that more than this share of the rows hold is hot; so there are at most this many hot keys.
HOT_SHARE = 256


def hot_join(rows: DataFrame, one: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, a row per ``key`` whose column ``count`` says how many of the ``total`` rows
    hold the key. Rows of hot keys, at most ``HOT_SHARE``, meet them by a broadcast where they are, so that no
    task gets all rows of a key; the rest is dealt by the key. Both are read twice, so written or cheap."""
    hot = (F.col(count) * HOT_SHARE > total) & (F.col(count) > 64)
    few = F.broadcast(one.where(hot).withColumn("__hot", F.lit(True)))
    here = rows.join(few, key)
    rest = rows.join(few.select(key), key, "left_anti").join(one.where(~hot), key, how)
    return here.drop("__hot").unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan of one column, one number to the driver."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"])
