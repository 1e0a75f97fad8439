"""Arrow passes that see whole groups of rows, many groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def array(rows: pa.Table, name: str) -> pa.Array:
    c = rows.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def whole_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``fn`` gets rows sorted by ``keys`` and ``order`` that hold whole groups, and where each group begins. A group
    must fit into a worker; small ones share a batch, so that none costs a call."""

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            codes = array(rows, k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            at = begins(rows)
            if len(at) > 1:
                yield from fn(rows.slice(0, int(at[-1])).combine_chunks(), at[:-1]).combine_chunks().to_batches()
                held = rows.slice(int(at[-1])).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from fn(rows, begins(rows)).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def schema_of(df: DataFrame, more: str, without: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes if c not in without), more])
