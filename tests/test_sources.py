"""Files and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.sources import files as I
from harrow.streaming import samples as W

SCHEMA = T.StructType().add("group_id", T.LongType()).add("x", T.StringType())


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))
    return str(path)


def test_lines(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", ['{"group_id": 1, "x": "a"}', "", "not json", '{"group_id": "z"}', '{"group_id": 2, "x": "b"}'])
    assert sorted(r["group_id"] for r in I.read_lines(spark, p, SCHEMA).collect()) == [1, 2]
    with pytest.raises(Exception):
        I.read_lines(spark, p, SCHEMA, strict=True).collect()
    a = write(tmp_path / "b.json", [json.dumps([{"group_id": 7, "x": "q"}], indent=1)])
    assert I.read_any(spark, a, SCHEMA).first()["group_id"] == 7 and I.read_any(spark, p, SCHEMA).count() == 2
    assert I.first_existing(spark, [str(tmp_path / "no"), p]) == p
    with pytest.raises(FileNotFoundError):
        I.first_existing(spark, ["/no/where"])
    assert [r["value"] for r in I.read_numbered(spark, p).orderBy("line").collect()][0].startswith('{"group_id": 1')


def test_parts_resume_and_dual(spark, tmp_path):
    for n in (2, 10):
        write(tmp_path / f"part_{n}" / "r.jsonl", [json.dumps({"group_id": n, "x": "a"})])
    rows = I.read_parts(spark, f"{tmp_path}/part_*", SCHEMA)
    assert sorted(r["part"] for r in rows.collect()) == [2, 10]
    out = str(tmp_path / "done")
    I.append(rows.where("group_id = 2").select("group_id", "x"), out)
    assert [r["group_id"] for r in I.resume(rows, out, "group_id", SCHEMA).collect()] == [10]
    assert I.resume(rows, str(tmp_path / "none"), "group_id", SCHEMA).count() == 2
    I.write_both(rows, str(tmp_path / "both"))
    assert spark.read.parquet(str(tmp_path / "both.parquet")).count() == spark.read.json(str(tmp_path / "both.jsonl")).count() == 2
    I.write_shards(rows.withColumn("shard", F.col("part") % 2), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2


def test_codec(spark):
    df = spark.createDataFrame([([10, 11], 2), ([], 0), (None, -1)], "t array<int>, n int")
    back = df.withColumn("p", I.encode_tokens("t")).withColumn("b", I.decode_tokens("p")).collect()
    assert [r["b"] for r in back] == [[10, 11], [], None]
    with pytest.raises(Exception, match="32 bits"):
        spark.createDataFrame([([-1],)], "t array<int>").select(I.encode_tokens("t")).collect()
    bad = df.where("n = 2").withColumn("p", I.encode_tokens("t")).withColumn("c", F.lit(3))
    with pytest.raises(Exception, match="token count"):
        I.decoded(bad, "p", "c", "ids").collect()


def test_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 1)], "id long, token_schema_version int")
    assert I.cache_valid(df, 2, 1) and not I.cache_valid(df, 3, 1) and not I.cache_valid(df, 2, 2)
    a, b = spark.createDataFrame([(1, None, "x")], "a int, b int, c string"), spark.createDataFrame([(1, None, "y")], "a int, b int, c string")
    assert [r["field"] for r in I.config_differences(a, b).collect()] == ["c"]
    I.check_source(df, 2, ["id"])
    with pytest.raises(ValueError):
        I.check_source(df, 3, ["id"])
    with pytest.raises(ValueError):
        I.check_source(df, None, ["answer"])
    path = str(tmp_path / "m.json")
    for n in (1, 2):
        I.write_manifest(spark, path, {"n": n})
    assert json.load(open(path)) == {"n": 2}
    assert I.archive(spark, path, "old") == f"{path}.old" and I.archive(spark, path, "old2") is None
    files = spark.createDataFrame([(f"c/global_step_{s}/model_world_size_2_rank_{r}.pt",) for s, r in ((10, 0), (10, 1), (20, 0))], "path string")
    assert [tuple(r) for r in I.complete_steps(files).collect()] == [(10, 2)]
    assert "<td>1</td>" in I.leaderboard_html(df)


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(30)], "queue string, id long")
    rows.where("id < 17").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("id >= 17").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = W.batches(stream(), 4).writeStream.format("memory").queryName("batches").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select queue, batch, count(*) from batches group by 1, 2").collect())
    want = W.assembled(rows, 4, "queue", "id").where("batch is not null").groupBy("queue", "batch").count().collect()
    assert got == sorted(tuple(r) for r in want)
    q = W.bounded_queue(stream(), 5).writeStream.format("memory").queryName("queues").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["queue"]: tuple(r) for r in spark.sql("select queue, max(produced), max(dropped), max_by(held, produced) from queues group by 1").collect()}
    assert last == {r["queue"]: (r["queue"], r["produced"], r["dropped"], r["held"]) for r in W.queue_totals(rows, 5, "queue").collect()}
    W.incremental(stream(), str(tmp_path / "c3"), lambda b: b.where("id % 2 = 0"), str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
