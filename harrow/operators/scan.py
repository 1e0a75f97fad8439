"""Recurrences over sequences of any length, one row per token.

A step x_i = a_i x_(i+1) + b_i is an affine map, and maps compose: a stretch of tokens is one map (A, B), however long. So
sequences are cut into chunks of positions; each chunk composes its maps from each of its tokens to its end, by
doubling, in NumPy; the maps of whole chunks, one row each, are scanned in the same way, and what they give joins back as the chunk's
carry, after which x_i = A_i carry + B_i is a column expression. No task sees more of a sequence than a chunk.

Positions count from 0 without repeats; gaps do no harm. Sequences of one chunk take one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.segments import array, schema_of, whole_groups
from harrow.sources.tables import cut

CHUNK = 4096


def compose(a: np.ndarray, b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps from each token to the end of its segment; ``begins`` says where segments begin."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    segment = np.zeros(len(a), np.int64)
    segment[begins[1:]] = 1
    segment = np.cumsum(segment)
    step = 1
    while step < len(a):
        i = np.flatnonzero(segment[:-step] == segment[step:])
        if not len(i):
            break
        a[i], b[i] = a[i] * a[i + step], b[i] + a[i] * b[i + step]
        step *= 2
    return a, b


def longest(df: DataFrame, pos: str) -> int:
    """The largest position: one number."""
    return df.agg(F.max(pos).alias("p")).first()["p"] or 0


def affine_scan(df: DataFrame, seq: str, pos: str, a: Column, b: Column, name: str | None = None, after: str | None = None, last: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: x_i = a_i x_(i+1) + b_i, where x is 0 after the last token; and ``after``: x_(i+1). ``last`` is the
    largest position, if known."""
    last = longest(df, pos) if last is None else last
    rows = df.withColumns({"__a": a.cast("double"), "__b": b.cast("double"), "__chunk": F.floor(F.col(pos) / chunk).cast("long")})

    def run(t: pa.Table, begins: np.ndarray) -> pa.Table:
        x, y = compose(array(t, "__a").to_numpy(zero_copy_only=False), array(t, "__b").to_numpy(zero_copy_only=False), begins)
        ends = np.append(begins[1:], len(x)) - 1
        x1, y1 = np.append(x[1:], 1.0), np.append(y[1:], 0.0)
        x1[ends], y1[ends] = 1.0, 0.0
        head = np.zeros(len(x), bool)
        head[begins] = True
        t = t.drop_columns(["__a", "__b"])
        for c, v in (("__A", x), ("__B", y), ("__A1", x1), ("__B1", y1), ("__head", head)):
            t = t.append_column(c, pa.array(v))
        return t

    schema = schema_of(rows, "__A double, __B double, __A1 double, __B1 double, __head boolean", ("__a", "__b"))
    local = whole_groups(rows, [seq, "__chunk"], [pos], run, schema)
    if last < chunk:
        local = local.withColumn("__carry", F.lit(0.0))
    else:
        local = cut(local)
        # names of their own at each depth
        key, at, later = f"__of_{seq}", f"__at_{pos}", f"__later_{pos}"
        heads = local.where("__head").select(F.col(seq).alias(key), F.col("__chunk").alias(at), "__A", "__B")
        carry = affine_scan(heads, key, at, F.col("__A"), F.col("__B"), after=later, last=last // chunk, chunk=chunk)
        carry = carry.select(key, at, F.col(later).alias("__carry"))
        local = local.join(carry, F.col(seq).eqNullSafe(F.col(key)) & (F.col("__chunk") == F.col(at))).drop(key, at)
    out = {n: F.col(f"__A{i}") * F.col("__carry") + F.col(f"__B{i}") for n, i in ((name, ""), (after, "1")) if n}
    return local.withColumns(out).drop("__A", "__B", "__A1", "__B1", "__head", "__chunk", "__carry")
