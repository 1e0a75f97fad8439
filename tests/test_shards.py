"""NPZ shards: round trips, archives of others, and what is refused."""

import pickle

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harrow.sources import shards


def rows(n):
    return [(list(range(i % 4)), [1] * (i % 4), [0] * (i % 4), i, i % 2 == 0, 1, 2, False, "stop", "é\n", 9, i // 3, i, i / 4) for i in range(n)]


def arrays(n):
    out = {}
    for (name, (kind, dtype)), values in zip(shards.FIELDS.items(), zip(*rows(n), strict=True), strict=True):
        if kind.startswith("array"):
            out[name] = np.empty(n, object)
            out[name][:] = [np.array(v, dtype) for v in values]
        else:
            out[name] = np.array(values, dtype=dtype)
    return out


def test_round_trip(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.createDataFrame(rows(50), shards.SCHEMA)
    shards.write_shards(df.repartition(3), path, rows=8)
    assert sorted(map(tuple, shards.read_shards(spark, path).collect())) == sorted(map(tuple, rows(50)))
    few = shards.read_shards(spark, path, ["group_id", "input_ids"])
    assert few.columns == ["group_id", "input_ids"] and few.agg(F.sum("group_id"), F.sum(F.size("input_ids"))).first()[:] == (sum(i // 3 for i in range(50)), sum(i % 4 for i in range(50)))
    assert shards.read_shards(spark, path).count() == 50 and few.rdd.getNumPartitions() >= 7
    shards.write_shards(df.limit(2), path)
    assert shards.read_shards(spark, path).count() == 52
    shards.write_shards(df.limit(3), path, mode="overwrite")
    assert shards.read_shards(spark, path).count() == 3
    assert not [f for f in (tmp_path / "s").iterdir() if f.suffix != ".npz"]
    shards.write_shards(df.limit(0), path, mode="overwrite")
    assert shards.read_shards(spark, path).collect() == []


def test_other_archives(spark, tmp_path):
    """Written by the library itself, with pickles; token fields of one length as a table."""
    np.savez_compressed(tmp_path / "a.npz", **arrays(7))
    square = arrays(3) | {k: np.arange(6).reshape(3, 2) for k in ("input_ids", "attention_mask", "response_mask")}
    np.savez(tmp_path / "b.npz", **square)
    got = {(r.global_index, tuple(r.input_ids)) for r in shards.read_shards(spark, f"file://{tmp_path}").collect()}
    assert got == {(i, tuple(range(i % 4))) for i in range(7)} | {(i, (2 * i, 2 * i + 1)) for i in range(3)}
    assert shards.read_shards(spark, str(tmp_path / "b.npz")).count() == 3


class Bad:
    def __reduce__(self):
        return (print, ("run",))


def test_refused(spark, tmp_path):
    def fails(match, **changed):
        given = {k: v for k, v in (arrays(3) | changed).items() if v is not None}
        np.savez(tmp_path / "x.npz", **given)
        with pytest.raises(PySparkException, match=match):
            shards.read_shards(spark, str(tmp_path / "x.npz")).collect()

    fails("lacks .*reward_score", reward_score=None)
    fails("different lengths", group_id=np.arange(4))
    fails("not allowed in a shard", input_ids=np.array([Bad(), Bad(), Bad()], dtype=object))
    with pytest.raises(pickle.UnpicklingError):
        shards._Arrays(__import__("io").BytesIO(pickle.dumps(Bad()))).load()
    null = spark.createDataFrame(rows(2), shards.SCHEMA).withColumn("reward_score", F.lit(None).cast("double"))
    with pytest.raises(PySparkException, match="reward_score is null"):
        shards.write_shards(null, str(tmp_path / "n"))
    with pytest.raises(PySparkException, match="no shards at"):
        shards.read_shards(spark, str(tmp_path / "none")).collect()


def test_many_archives_share_partitions(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.createDataFrame(rows(300), shards.SCHEMA).coalesce(2)
    shards.write_shards(df, path, rows=1)
    assert len(list((tmp_path / "s").iterdir())) == 300
    back = shards.read_shards(spark, path)
    assert shards.ALONE <= back.rdd.getNumPartitions() <= 2 * shards.ALONE
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows(300)))
    sizes = [("a", 5 << 20), ("b", 9 << 20), *((f"c{i}", 1 << 20) for i in range(900))]
    shared = shards._shared(sizes)
    assert [p for part in shared for p in part] == [p for p, _ in sizes] and shared[:2] == [["a"], ["b"]] and {len(p) for p in shared[2:]} == {4}


def test_numbers_out_of_range(spark, tmp_path):
    """Neither cut nor wrapped."""
    df = spark.createDataFrame(rows(2), shards.SCHEMA)
    for name, value in (("requested_max_tokens", F.lit(1 << 31)), ("response_mask", F.array(F.lit(256).cast("long"))), ("input_ids", F.array(F.lit(1), F.lit(None)).cast("array<bigint>"))):
        with pytest.raises(PySparkException):
            shards.write_shards(df.withColumn(name, value), str(tmp_path / "n"))
