"""Benchmarks and training sources by name."""

import json

import pytest
from pyspark.sql import functions as F

from harrow.sources import benchmarks as B
from harrow.sources import files as I
from harrow.sources import prompts as P


def lines(tmp_path, rows):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_names():
    assert B.names() == list(B.BENCHMARKS) and len(B.names()) == 9
    assert B.names(["HMMT-Feb-2026", "minerva", "hmmt26", "GSM-8k"]) == ["hmmt26", "minerva_math", "gsm8k"]
    with pytest.raises(ValueError, match="unknown benchmark 'aime27'"):
        B.names(["aime27"])


def test_faults(spark, tmp_path):
    path = lines(tmp_path, ['﻿{"question": "q", "answer": "1 #### 2"}', "", "[1]", "{broken", {"question": " ", "answer": "#### 4"}, {"question": "q", "answer": None}, {"answer": "#### 5"}])
    got = sorted((r["line"] if r["line"] is not None else -1, r["fault"]) for r in B.faults(B.read(spark, path), "gsm8k").collect())
    assert got == [(-1, "6 rows, not 1319"), (2, "not a JSON object"), (3, "not a JSON object"), (4, "empty question or answer"), (5, "empty question or answer"), (6, "empty question or answer"), (6, "missing keys: question")]
    with pytest.raises(ValueError, match="gsm8k: 6 rows, not 1319; line 2: not a JSON object"):
        B.check(B.read(spark, path), "gsm-8k")
    pointer = B.read(spark, lines(tmp_path, ["version https://git-lfs.github.com/spec/v1", "oid sha256:00"]))
    assert ("a pointer to a stored file" in [r["fault"] for r in B.faults(pointer, "aime24").collect()]) and [r["pointer"] for r in pointer.orderBy("line").collect()] == [True, False]
    full = [{"id": i, "problem": f"p{i}", "answer": i} for i in range(30)]
    B.check(B.read(spark, lines(tmp_path, full)), "aime2025")
    assert B.faults(B.read(spark, lines(tmp_path, [])), "aime24").first()["fault"] == "0 rows, not 30"


@pytest.mark.parametrize(
    ("name", "row", "want"),
    [
        ("amc23", {"id": 3, "problem": "p", "answer": 27.0}, ("p", "27", None, "3")),
        ("amc23", {"id": "x", "problem": "p", "answer": "27.0"}, ("p", "27.0", None, "x")),
        ("aime26", {"id": 1, "problem": "p", "answer": 0.5, "problem_idx": 9, "problem_type": ["Algebra", " ", "Sets "]}, ("p", "0.5", "Algebra, Sets", "9")),
        ("hmmt26", {"problem_idx": 2, "problem": "p", "answer": " \\frac{1}{2}\n", "type": "a"}, ("p", "\\frac{1}{2}", "a", "2")),
        ("math500", {"problem": "p", "solution": "s", "answer": "4", "unique_id": "", "id": "u"}, ("p", "4", None, "u")),
        ("minerva_math", {"problem": "p", "solution": "\\boxed{1} and \\boxed{ {a} }", "type": "t", "idx": 0}, ("p", "{a}", "t", "0")),
        ("olympiadbench", {"id": 5, "question": "q", "solution": "s", "final_answer": ["1 ", "$x$"], "subfield": "g"}, ("q", "1, $x$", "g", "5")),
        ("gsm8k", {"question": "q", "answer": "a #### b\n#### 1,000"}, ("q", "1,000", None, "")),
    ],
)
def test_standardized(spark, tmp_path, name, row, want):
    rows = B.read(spark, lines(tmp_path, [row]))
    got = B.standardized(rows, name).first()
    assert (got["question"], got["answer"], got["category"], got["source_id"]) == want
    assert [r["fault"] for r in B.faults(rows, name).collect()] == [f"1 rows, not {B.BENCHMARKS[name].rows}"]


def test_lists_and_boxes(spark, tmp_path):
    row = {"id": 5, "question": "q", "solution": "s", "final_answer": "1"}
    assert {"the final answers are not a filled list"} <= {r["fault"] for r in B.faults(B.read(spark, lines(tmp_path, [row])), "olympiadbench").collect()}
    for solution, fault in (("none", "no box"), ("\\boxed x", "no brace"), ("\\boxed{1} \\boxed{2", "unbalanced")):
        row = {"problem": "p", "solution": solution, "type": "t", "idx": 1}
        assert f"the solution's last box: {fault}" in [r["fault"] for r in B.faults(B.read(spark, lines(tmp_path, [row])), "minerva").collect()]


def test_input(spark, tmp_path):
    a = B.as_rows(spark.createDataFrame([(7, "p7", 1.0), (5, "p5", 2.0)], "id long, problem string, answer double").withColumn("n", F.col("id")), "n")
    g = B.as_rows(spark.createDataFrame([(0, "q", "#### 3")], "n long, question string, answer string"), "n")
    rows = B.evaluation_input({"amc23": a, "gsm8k": g}, "be short").orderBy("extra_info.index").collect()
    assert [(r["data_source"], r["reward_model"]["ground_truth"], *r["extra_info"]) for r in rows] == [("amc23", "2", 0, "amc23", 0, "5", ""), ("amc23", "1", 1, "amc23", 1, "7", ""), ("gsm8k", "3", 2, "gsm8k", 0, "", "")]
    assert [tuple(m) for m in rows[0]["prompt"]] == [("system", "be short"), ("user", "p5")]
    with pytest.raises(ValueError, match="no benchmarks"):
        B.evaluation_input({})


def test_sources(spark):
    assert P.source_name("MMLU_Pro") == "mmlupro" and P.source_name("hendrycks_math") == "math"
    with pytest.raises(ValueError, match="unknown source"):
        P.source_name("mathematics")
    one = lambda key, row, schema, **kw: tuple(P.standardized({p: spark.createDataFrame([row], schema) for p in P.SOURCES[P.source_name(key)].parts}, key, "n", **kw).select("id", "problem", "answer").first())
    assert one("metamath", (1, "q", "so. The answer is: 4"), "n int, query string, response string") == ("", "q", "4")
    assert one("strategy-qa", (1, "i", "q", False), "n int, id string, question string, answer boolean") == ("i", "q", "False")
    assert one("webinstruct", (1, 8, "q", "a"), "n int, task_id int, original_question string, short_answer string") == ("8", "q", "a")
    assert one("gsm8k", (1, "q", "x\n#### 1,200 "), "n int, question string, answer string") == ("", "q", "1,200")
    assert one("math500", (1, "q", "\\sqrt{2}"), "n int, problem string, answer string") == ("", "q", "\\sqrt{2}")
    chat = ([("solve it, that is the answer to the problem.\n\nWhat?\nRemember to put your answer on its own line after \"Answer:\".", "user")], ("34",), (77,), 1)
    assert one("dapo-math-17k", chat, "prompt array<struct<content:string,role:string>>, reward_model struct<ground_truth:string>, extra_info struct<index:int>, n int") == ("77", "What?", "34")
    url = spark.createDataFrame([(1, "2022_AMC_1", "p", 3.0), (2, "2023_AMC_1", "q", 4.0)], "n int, url string, problem string, answer double")
    assert [(r["problem"], r["answer"]) for r in P.standardized({"train": url}, "amc23", "n").collect()] == [("q", "4")]
    assert P.standardized({"train": url}, "amc", "n", most=1).first()["problem"] == "p"
    with pytest.raises(ValueError, match="not given"):
        P.standardized({"aime24": url}, "aime", "n")


def test_halves_and_splits(spark):
    rows = spark.range(101).select(F.col("id").alias("n"), "id", F.col("id").alias("Question"), F.lit("a").alias("Answer"))
    first, second = ({r["id"] for r in P.standardized({"test": rows}, k, "n").collect()} for k in ("theoremqa_train", "theoremqa_test"))
    assert len(first) == 50 and len(second) == 51 and not first & second
    few = P.standardized({"test": rows}, "theoremqa_train", "n", most=5)
    assert {r["id"] for r in few.collect()} <= first and few.count() == 5
    recs = P.records(P.standardized({"test": rows}, "theoremqa", "n", most=3), "theoremqa")
    assert [(r["extra_info"]["index"], r["extra_info"]["split"]) for r in recs.orderBy("extra_info.index").collect()] == [(0, "train"), (1, "train"), (2, "train")]
    assert P.of_split(recs, "val").count() == 3 and P.of_split(recs.where("extra_info.index < 0"), "val").count() == 0
    assert spark.range(1).select(P.user_prompt(F.lit("Is it"), "strategyqa").alias("p")).first()["p"].endswith("\n\nIs it. Your answer should be True/False.")


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, ("ü", None), {"b": 1, "a": 2}, [("y", 1)], None)], "z int, s struct<q:string,a:int>, m map<string,int>, l array<struct<k:string,c:int>>, n struct<a:int>")
    got = df.select(I.canonical_json(df, *df.columns).alias("j")).first()["j"]
    assert got == json.dumps({"z": 1, "s": {"q": "ü", "a": None}, "m": {"b": 1, "a": 2}, "l": [{"k": "y", "c": 1}], "n": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
