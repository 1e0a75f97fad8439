"""Readers and writers: lenient and strict JSON lines, partitioned folders, token codec, caches, manifests."""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_corrupt_record"


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = False, keep_bad: bool = False) -> DataFrame:
    """JSON lines of a given schema. Lenient: blank and malformed rows are skipped, or kept as null rows.
    Strict: the first bad row fails the read."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST", encoding="UTF-8")
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    row = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = spark.read.text(path).withColumn("__row", F.when(F.trim("value") != "", row))
    if not keep_bad:
        rows = rows.where(F.col("__row").isNotNull() & F.col(f"__row.{_BAD}").isNull())
    return rows.select(*(F.col(f"__row.{c}").alias(c) for c in schema.names))


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, value) of the rows that aren't JSON of the schema, lines from 1 in each file; a byte order
    mark before the first one is passed over. Lines are numbered within the blocks of a file, and the lines of
    the blocks before are added, so no task numbers a whole file."""
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    m, block = F.col("_metadata"), ["file", "block"]
    rows = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    # a block's lines are in one partition, where these ids ascend by one
    sizes = rows.groupBy(*block).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = F.regexp_replace("value", "^\ufeff", "")
    parsed = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    bad = F.when(F.trim(text) != "", parsed[_BAD].isNotNull() | ~F.trim(text).startswith("{")).otherwise(False)
    starts = sizes.select(*block, (before - F.col("first") + 1).alias("shift"))
    return rows.where(bad).join(starts, block).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON list of objects."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for p in paths:
        if _exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths} exists")


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet beside a JSON file of the same name if there is one; else a JSON list or JSON lines, by the first character."""
    twin = path.rsplit(".", 1)[0] + ".parquet"
    if path.endswith(".parquet") or _exists(spark, twin):
        return spark.read.parquet(path if path.endswith(".parquet") else twin)
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return read_array(spark, path, schema) if first and first[0][0].lstrip().startswith("[") else read_lines(spark, path, schema)


def read_parts(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Rows of part_<number> folders with the part's number and a line order within it."""
    rows = read_lines(spark, pattern, schema)
    part = F.regexp_extract(F.input_file_name(), r"part_(\d+)", 1)
    return rows.withColumns({"part": F.when(part != "", part.cast("int")), "line": F.monotonically_increasing_id()})


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of text files from 0, by the names of the files and within them."""
    from harrow.operators.select import ranked

    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    rows = spark.read.text(path).select("value", at.alias("__f"), F.monotonically_increasing_id().alias("__i"))
    return ranked(rows, ["__f", "__i"], "line").select((F.col("line") - 1).alias("line"), "value")


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines and, unless there are none, as Parquet."""
    df.write.mode("overwrite").json(f"{path}.jsonl")
    if not df.isEmpty():
        df.write.mode("overwrite").parquet(f"{path}.parquet")


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder per shard, of one file each."""
    df.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def resume(rows: DataFrame, path: str, id: str, schema: T.StructType) -> DataFrame:
    """Rows whose id the output doesn't hold yet."""
    spark = rows.sparkSession
    return rows.join(read_lines(spark, path, schema).select(id).distinct(), id, "left_anti") if _exists(spark, path) else rows


def resume_strict(rows: DataFrame, done: DataFrame, id: str, signature: str, want: str) -> DataFrame:
    """Rows whose id is not done; done rows of another signature, or done twice, are errors."""
    n = done.groupBy(id).agg(F.count("*").alias("n"), F.count_if(~F.col(signature).eqNullSafe(F.lit(want))).alias("other"))
    wrong = n.where("n > 1 or other > 0").orderBy(id).limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"{r[id]}: {'another signature' if r['other'] else 'twice'}" for r in wrong))
    return rows.join(n.select(id), id, "left_anti")


def result_summaries(spark: SparkSession, root: str) -> DataFrame:
    """(selection, experiment, checkpoint_step, overall, summary_path) of complete summaries of a results folder,
    in that order; files that aren't JSON are passed over."""
    schema = "status string, selection string, experiment string, checkpoint_step long, overall string"
    files = spark.read.text(f"{root}/*/*/global_step_*/*/summary.json", wholetext=True).select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_path").alias("summary_path"))
    return files.where("r.status = 'complete'").select("r.selection", "r.experiment", "r.checkpoint_step", "r.overall", "summary_path").orderBy("selection", "experiment", F.coalesce("checkpoint_step", F.lit(-1)), "summary_path")


def dump_steps(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("step").json(path)


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """One JSON object, written beside and renamed, so that a reader sees the old or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(content, sort_keys=True, indent=1).encode()))
    out.close()
    # a rename that puts the new one in the old one's place, which FileSystem.rename doesn't
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(target), options)


def archive(spark: SparkSession, path: str, tag: str) -> str | None:
    """Moves an old output aside; where to, or None if there was none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{path}.{tag}"))
    return f"{path}.{tag}"


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns' canonical JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """The columns as compact JSON with sorted keys, nested ones too, and nulls written; a map's keys ascend."""

    def ordered(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*(ordered(x[f], kind[f].dataType).alias(f) for f in sorted(kind.names))))
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda y: ordered(y, kind.elementType))
        if isinstance(kind, T.MapType):
            entries = F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], ordered(e["value"], kind.valueType))))
        return x

    return F.to_json(F.struct(*(ordered(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def cache_valid(df: DataFrame, rows: int, version: int, column: str = "token_schema_version") -> bool:
    """Are there as many rows as there should be, all of the current version?"""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col(column).eqNullSafe(F.lit(version))), F.lit(False)).alias("ok")).first()
    return r["n"] == rows and r["ok"]


def config_differences(have: DataFrame, want: DataFrame) -> DataFrame:
    """(field, have, want) of fields that differ between two one-row configurations, nulls being equal."""
    names = sorted({*have.columns} | {*want.columns})
    value = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), (F.col(n) if n in df.columns else F.lit(None)).cast("string").alias(side)) for n in names))).alias("x")).select("x.*")
    return value(have, "have").join(value(want, "want"), "field").where(~F.col("have").eqNullSafe(F.col("want")))


def check_source(df: DataFrame, rows: int | None, required: list[str]) -> None:
    """Fails unless a benchmark has its columns and number of rows, and isn't a pointer to a stored file."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing")
    if len(df.columns) == 1 and not df.where(F.col(df.columns[0]).cast("string").startswith("version https://git-lfs")).isEmpty():
        raise ValueError("the file is a pointer, not data")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"there are {n} rows, not {rows}")


# ---- token codec ---------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def encode_tokens(ids: pd.Series) -> pd.Series:
    """base64 of zlib of little-endian 32-bit ids; a negative or too large id fails."""

    def one(x) -> str | None:
        if x is None:
            return None
        a = np.asarray(x, np.int64)
        if len(a) and (a.min() < 0 or a.max() >= 1 << 32):
            raise ValueError("a token id doesn't fit 32 bits")
        return base64.b64encode(zlib.compress(a.astype("<u4").tobytes())).decode()

    return ids.map(one)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_tokens(text: pd.Series) -> pd.Series:
    def one(x: str | None):
        if x is None:
            return None
        a = np.frombuffer(zlib.decompress(base64.b64decode(x, validate=True)), "<u4")
        if len(a) and a.max() >= 1 << 31:
            raise ValueError("a token id doesn't fit a signed integer")
        return a.astype(np.int32)

    return text.map(one)


def decoded(df: DataFrame, payload: str, count: str, name: str) -> DataFrame:
    """Adds the ids; a row whose stated count is another fails."""
    out = df.withColumn(name, decode_tokens(payload))
    return out.where(F.assert_true(F.size(name) == F.col(count), F.lit("the stated token count differs from the payload")).isNull())


def leaderboard(df: DataFrame, row: list[str], benchmark: str, value: str, names: list[str]) -> DataFrame:
    """A column per benchmark, as percentages of six decimals."""
    wide = df.groupBy(*row).pivot(benchmark, names).agg(F.first(value))
    return wide.select(*row, *(F.format_string("%.6f", F.col(n) * 100).alias(n) for n in names))


def leaderboard_html(df: DataFrame, most: int = 10_000) -> str:
    """A page with all rows; more than ``most`` of them are an error, as a page is no place for them."""
    from html import escape

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is too long for a page")
    cells = lambda xs, tag: "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in xs)
    return f"<table><tr>{cells(df.columns, 'th')}</tr>{''.join(f'<tr>{cells(r, "td")}</tr>' for r in rows)}</table>"


def kept(spark: SparkSession, root: str, name: tuple[str, str], batch: int, n: int, make: Callable[[], DataFrame]) -> DataFrame:
    """Rollouts of (experiment, project) with ``n`` responses to each of a ``batch`` of prompts: those that a finished write left
    in ``root``, else what ``make`` gives, written there first. A write that was cut short is done again."""
    path = f"{root.rstrip('/')}/{name[0]}_{name[1]}_GBS{batch}__N{n}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def complete_steps(files: DataFrame, path: str = "path") -> DataFrame:
    """(step, ranks): steps of checkpoint files ".../global_step_<n>/..._world_size_<w>_rank_<r>..." of which all ranks are there."""
    f = F.col(path)
    rows = files.select(F.regexp_extract(f, r"global_step_(\d+)", 1).try_cast("long").alias("step"), F.regexp_extract(f, r"world_size_(\d+)_rank_(\d+)", 1).try_cast("int").alias("world"), F.regexp_extract(f, r"world_size_(\d+)_rank_(\d+)", 2).try_cast("int").alias("rank"))
    return rows.where("step is not null and rank is not null").groupBy("step").agg(F.countDistinct("rank").alias("ranks"), F.max("world").alias("world")).where("ranks = world").select("step", "ranks")
