"""NPZ shards of analysed responses as a data source: archives are read one after the other, many small ones in one partition, and
only the wanted members are unpacked.

An archive has one array per field. Token fields are ragged: an object array of arrays, stored as a pickle that is read
by an unpickler which knows arrays and nothing else; arrays of two dimensions are read too. An archive that lacks one of
the fields, whose arrays differ in length, or whose pickle holds anything else is an error that names it; an empty
folder is an empty table. Null values can't be stored and are an error. Files are written beside the table and moved
into it when all tasks are done, so a repeated task leaves no second copy.
"""

from __future__ import annotations

import io
import pickle
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The fields of a shard and their types on disk.
FIELDS = {
    "input_ids": ("array<bigint>", np.int64),
    "attention_mask": ("array<bigint>", np.int64),
    "response_mask": ("array<bigint>", np.uint8),
    "original_input_length": ("bigint", np.int32),
    "was_truncated": ("boolean", np.bool_),
    "prompt_length": ("bigint", np.int32),
    "generated_response_length": ("bigint", np.int32),
    "generation_hit_max_tokens": ("boolean", np.bool_),
    "generation_finish_reason": ("string", object),
    "generation_stop_reason": ("string", object),
    "requested_max_tokens": ("bigint", np.int32),
    "group_id": ("bigint", np.int64),
    "global_index": ("bigint", np.int64),
    "reward_score": ("double", np.float32),
}
SCHEMA = ", ".join(f"{k} {t}" for k, (t, _) in FIELDS.items())
ROWS = 1024
#: A partition is an archive, up to so many; more share partitions of about so many bytes.
ALONE = 64
TOGETHER = 4 << 20


class _Arrays(pickle.Unpickler):
    """Pickles of NumPy arrays of numbers and text; nothing else is made."""

    def find_class(self, module: str, name: str):
        if module.startswith("numpy") and name in ("_reconstruct", "ndarray", "dtype", "_frombuffer", "scalar", "str_"):
            return super().find_class(module, name)
        if (module, name) == ("_codecs", "encode"):  # how old protocols write bytes
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a shard")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _archives(store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, bytes) in order."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no shards at {path}")
    return sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(".npz"))


def _shared(archives: list[tuple[str, int]]) -> list[list[str]]:
    """The archives of each partition, neighbours together; a file without bytes of its own counts as one."""
    size = max(1, min(TOGETHER, sum(max(1, n) for _, n in archives) // ALONE))
    out, held = [], 0
    for path, n in archives:
        if not out or len(archives) <= ALONE or held + n > size:
            out.append([])
            held = 0
        out[-1].append(path)
        held += max(1, n)
    return out


def _member(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    with archive.open(f"{name}.npy") as raw:
        version = np.lib.format.read_magic(raw)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
        if dtype.hasobject:
            return _Arrays(raw).load().reshape(shape)
    with archive.open(f"{name}.npy") as raw:
        return np.lib.format.read_array(io.BytesIO(raw.read()), allow_pickle=False)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        rows = [np.asarray(v, dtype=np.int64) for v in values]
        ends = np.cumsum([0, *(len(v) for v in rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))
    if pa.types.is_string(kind):
        return pa.array([str(v) for v in values], kind)
    return pa.array(values).cast(kind)


def _stored(name: str, values: pa.ChunkedArray) -> np.ndarray:
    """A column as it is on disk; a null, or a number out of the range of its type, is an error."""
    kind, dtype = FIELDS[name]
    if values.null_count:
        raise ValueError(f"{name} is null in a row of a shard")
    values = pa.concat_arrays(values.chunks)
    number = pa.from_numpy_dtype(dtype) if dtype is not object else None
    if kind.startswith("array"):
        flat, sizes = values.flatten(), np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
        if flat.null_count:
            raise ValueError(f"{name} is null in a row of a shard")
        flat, ends = flat.cast(number).to_numpy(zero_copy_only=False), sizes.tolist()
        out = np.empty(len(ends), dtype=object)
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            out[k] = flat[a:b]
        return out
    return np.array(values.to_pylist(), dtype=object) if number is None else values.cast(number).to_numpy(zero_copy_only=False)


@dataclass
class Archives(InputPartition):
    paths: list[str]


class ShardReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        unknown = [n for n in schema.names if n not in FIELDS]
        if unknown:
            raise ValueError(f"shards have no {unknown}")
        self.names, self.path = schema.names, path

    def partitions(self) -> list[Archives]:
        return [Archives(p) for p in _shared(_archives(*_store(self.path)))] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        for path in partition.paths:
            yield from self._rows(store, path)

    def _rows(self, store: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            missing = sorted(set(FIELDS) - {n.removesuffix(".npy") for n in archive.namelist()})
            if missing:
                raise ValueError(f"{path} lacks {missing}")
            kinds = {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
            # without a column the rows still count
            arrays = {n: _column(_member(archive, n), kinds[FIELDS[n][0]]) for n in self.names or ["group_id"]}
        if len({len(a) for a in arrays.values()}) > 1:
            raise ValueError(f"{path} has arrays of different lengths")
        table = pa.table({n: arrays[n] for n in self.names}) if self.names else pa.table(arrays).select([])
        yield from table.to_batches(max_chunksize=ROWS)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, rows: int, overwrite: bool):
        if sorted(schema.names) != sorted(FIELDS):
            raise ValueError(f"a shard has exactly the fields {sorted(FIELDS)}")
        self.names, self.path, self.rows, self.overwrite = schema.names, path, rows, overwrite
        self.beside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        store.create_dir(f"{path}/{self.beside}")
        files, held, n = [], [], 0

        def flush(rows: pa.Table) -> None:
            packed = io.BytesIO()
            np.savez_compressed(packed, **{name: _stored(name, rows.column(i)) for i, name in enumerate(self.names)})
            name = f"shard-{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{path}/{self.beside}/{name}", compression=None) as out:
                out.write(packed.getbuffer())
            files.append(name)

        for batch in iterator:
            held.append(batch)
            n += batch.num_rows
            if n >= self.rows:
                table = pa.Table.from_batches(held)
                for a in range(0, n - self.rows + 1, self.rows):
                    flush(table.slice(a, self.rows))
                held = table.slice(n // self.rows * self.rows).to_batches()
                n %= self.rows
        if n:
            flush(pa.Table.from_batches(held))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path)
        old = _archives(store, path) if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{path}/{self.beside}/{name}", f"{path}/{name}")
        for f, _ in old:
            store.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        if store.get_file_info(f"{path}/{self.beside}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.beside}")


class ShardSource(DataSource):
    """``npz_shards``: options path and, for writing, rows (of a shard, 1,024)."""

    @classmethod
    def name(cls) -> str:
        return "npz_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(schema, self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(schema, self.options["path"], int(self.options.get("rows", ROWS)), overwrite)


def read_shards(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """The rows of all shards of a folder, or of one file; ``fields`` are the members that are unpacked."""
    spark.dataSource.register(ShardSource)
    schema = SCHEMA if fields is None else ", ".join(f"{f} {FIELDS[f][0]}" for f in fields)
    return spark.read.format("npz_shards").schema(schema).load(path)


def write_shards(df: DataFrame, path: str, rows: int = ROWS, mode: str = "append") -> None:
    """One or more archives per partition of ``df``, of at most ``rows`` rows each."""
    df.sparkSession.dataSource.register(ShardSource)
    df.select(*FIELDS).write.format("npz_shards").mode(mode).option("rows", rows).save(path)
