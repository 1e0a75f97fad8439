"""Errors, files and shards beside the registered report queries."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import answers as N
from harrow.operators import metrics as M
from harrow.operators import pack as K
from harrow.operators import select as S
from harrow.operators import shape as P
from harrow.plans import catalog
from harrow.sources import files as I

ROW = T.StructType().add("id", "long").add("name", "string")


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + b'{"id": 1}\n\n{"id": 2\n[3]\n{"id": 4, "name": "x"}\nnull\n')
    (tmp_path / "b.jsonl").write_text("no\n")
    (tmp_path / "c.jsonl").write_text("")
    got = sorted((r.file[-7:], r.line, r.value) for r in I.bad_lines(spark, str(tmp_path), ROW).collect())
    assert got == [("a.jsonl", 3, '{"id": 2'), ("a.jsonl", 4, "[3]"), ("a.jsonl", 6, "null"), ("b.jsonl", 1, "no")]


def test_bad_lines_over_blocks(spark, tmp_path):
    lines = [json.dumps({"id": i, "name": "y" * (i % 50)}) if i % 97 else "bad" for i in range(5000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted(r.line for r in I.bad_lines(spark, str(tmp_path), ROW).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [i + 1 for i in range(5000) if i % 97 == 0]


def test_resume_strict(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(1, "v1")], "id long, sig string")
    assert sorted(r.id for r in I.resume_strict(rows, done, "id", "sig", "v1").collect()) == [2, 3]
    with pytest.raises(ValueError, match="another signature"):
        I.resume_strict(rows, done, "id", "sig", "v2")
    with pytest.raises(ValueError, match="twice"):
        I.resume_strict(rows, done.union(done), "id", "sig", "v1")


def test_result_summaries(spark, tmp_path):
    for sel, step, text in [("b", 20, '{"status": "complete", "selection": "b", "checkpoint_step": 20}'), ("a", 5, '{"status": "complete", "selection": "a", "overall": {"x": 1}}'), ("a", 6, '{"status": "running"}'), ("a", 7, "broken")]:
        d = tmp_path / sel / "e" / f"global_step_{step}" / "r"
        d.mkdir(parents=True)
        (d / "summary.json").write_text(text)
    got = I.result_summaries(spark, str(tmp_path)).collect()
    assert [(r.selection, r.checkpoint_step, r.overall) for r in got] == [("a", None, '{"x":1}'), ("b", 20, None)]


def test_uneven_groups_are_an_error(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "group_id long, sample_id long")
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        M.require_even(df)
    assert M.require_even(df.where("group_id = 1")).count() == 2


def test_parts_that_differ_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "x")], "k long, a string, b string")
    assert sorted(tuple(r) for r in P.agreed(df, ["k"], ["a", "b"]).collect()) == [(1, "a", None), (2, None, "x")]
    with pytest.raises(Exception, match="parts differ in b"):
        P.agreed(df.union(spark.createDataFrame([(1, "a", "x")], df.schema)), ["k"], ["a", "b"]).collect()


def test_equal_shards(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate([9, 1, 1, 8, 2, 2])], "batch long, id long, cost long")
    got = K.pack(df, 2, "batch", "id", "cost", "given_equal").collect()
    assert sorted((r.shard, r.id) for r in got) == [(0, 0), (0, 3), (0, 5), (1, 1), (1, 2), (1, 4)]
    with pytest.raises(Exception, match="divide"):
        K.pack(df, 4, "batch", "id", "cost", "given_equal").collect()
    assert [r.n for r in spark.range(1).select(K.rounded_count(F.lit(5), 4, F.lit(7)).alias("n")).collect()] == [7]


def test_groups_in_batches(spark):
    df = spark.createDataFrame([(b, g, float(r)) for b, g, rs in [(0, 1, (0, 1)), (0, 2, (1, 1)), (1, 3, (0, 1)), (2, 4, (1, 0)), (2, 5, (1,))] for r in rs], "batch long, group_id long, reward double")
    assert sorted({r.group_id for r in S.accumulated_groups(df, 3, 0).collect()}) == [1, 3, 4]
    with pytest.raises(ValueError, match="fewer than 3"):
        S.accumulated_groups(df, 3, 2)
    with pytest.raises(ValueError, match="differ"):
        S.same_ids(df, df.where("group_id < 4"))


def test_boxes_and_points(spark):
    assert [N.boxed_loose(t) for t in (r"\boxed 3$ x", r"\fbox{4}", r"\boxed{{5}}", "none", r"\boxed{6")] == ["3", "4", "{5}", None, None]
    assert [N.box_fault(t) for t in (r"\boxed{1}", "x", r"\boxed 3", r"\boxed{{1}")] == [None, "no box", "no brace", "unbalanced"]
    none = spark.range(1).select(N.box_reward(F.array().cast("array<struct<x:double,y:double>>"), *map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("r")).first()
    assert none.r == -1.0
    one = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(0.5).alias("y")) for x in (5.0, 0.5, 0.6)))
    assert abs(spark.range(1).select(N.box_reward(one, *map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("r")).first().r - 6**-0.5) < 1e-12


def test_padding_without_rows(spark):
    assert P.pad_with_end(spark.range(0), 4, "id").count() == 0
    assert [(r.id, r.at, r.pad) for r in P.pad_with_end(spark.range(3), 4, "id", last=False).orderBy("at").collect()] == [(0, 0, False), (1, 1, False), (2, 2, False), (0, 3, True)]


def test_step_scores_of_large_keys(spark, tmp_path):
    """Keys whose successors lie within the tolerance of numbers."""
    path = f"{tmp_path}/orders.parquet"
    duckdb.execute(f"COPY (SELECT i AS o_orderkey, k + i // 6 AS o_custkey FROM range(60) a(i), (VALUES (0), (9995), (20000), (8999999)) b(k)) TO '{path}'")
    want = duckdb.execute(catalog.oracle_sql()["step_scores"].replace("FROM orders", f"FROM '{path}'")).fetchall()
    got = catalog.queries()["step_scores"](spark, str(tmp_path)).select("o_orderkey", "correct", "format", "answer").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counting_task_computes_its_letters_once(spark):
    """The plan has one digest for each of: a letter, the number of letters, the letter to count, the split."""
    task = P.counting_task(F.col("id"), 7)
    df = spark.range(40).select(task.alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 8
    for r in df.select("t.*").collect():
        running = [r.word[: i + 1].count(r.letter) for i in range(len(r.word))]
        assert r.answer == running[-1] >= 1 and r.problem == f"How often does {r.letter} occur in {r.word}?"
        lines = "".join(f"{x} {'=' if x == r.letter else '!='} {r.letter}: {n}\n" for x, n in zip(r.word, running, strict=True))
        assert r.reasoning == f"{lines}\n\\boxed{{{r.answer}}}".replace("\n\n", "\n")
