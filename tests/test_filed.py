"""Prompt files, kept rollouts and lists with their lines."""

import json

import pytest
from pyspark.sql import functions as F

from harrow.functions import answers as A
from harrow.operators import select as T
from harrow.operators import spectral as X
from harrow.sources import files as I
from harrow.sources import prompts as P

TRAINED = {"data_source": "d", "prompt": [{"role": "user", "content": "p"}], "reward_model": {"ground_truth": "3"}, "extra_info": {"index": 7}}


def file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [tuple(r)[:5] for r in df.orderBy("line").collect()]


def test_prompt_lines(spark, tmp_path):
    one = json.dumps(TRAINED)
    path = file(tmp_path, "a.jsonl", f"{one}\n\n{one}\n{one}\n")
    problem = '[{"content":"p","role":"user"}]'
    assert rows(P.read_prompts(spark, path)) == [(n, problem, "3", 7, "d") for n in (1, 3, 4)]
    assert [r[0] for r in rows(P.read_prompts(spark, path, 2, 3))] == [3]
    # one other entry makes all of them generic
    mixed = file(tmp_path, "b.jsonl", f'{one}\n{{"problem": "q", "prompt": "r", "ground_truth": 4}}\n{{"x": 1}}')
    assert rows(P.read_prompts(spark, mixed)) == [(1, problem, "", None, "d"), (2, "q", "4", None, ""), (3, '{"x":1}', "", None, "")]
    assert rows(P.read_prompts(spark, mixed, last=1)) == [(1, problem, "3", 7, "d")]
    with pytest.raises(Exception, match="no JSON object in line 2"):
        P.read_prompts(spark, file(tmp_path, "c.jsonl", f"{one}\n{one[:20]}")).collect()
    assert rows(P.read_prompts(spark, file(tmp_path, "d.jsonl", ""))) == []


def test_prompt_lists(spark, tmp_path):
    path = file(tmp_path, "a.json", json.dumps([{"problem": "q", "answer": 1}, {"problem": None, "prompt": "r"}, {"problem": "s"}], indent=1))
    assert rows(P.read_prompts(spark, path)) == [(1, "q", "1", None, ""), (2, "r", "", None, ""), (3, "s", "", None, "")]
    assert [r[1] for r in rows(P.read_prompts(spark, path, 2, 2))] == ["r"]
    assert rows(P.read_prompts(spark, file(tmp_path, "b.json", "[]"))) == []


def test_kept(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    args = (spark, str(tmp_path), ("e", "p"), 8, 4)
    assert I.kept(*args, make).count() == I.kept(*args, make).count() == 3 and len(made) == 1
    (tmp_path / "e_p_GBS8__N4" / "_SUCCESS").unlink()
    assert I.kept(*args, make).count() == 3 and len(made) == 2
    assert I.kept(spark, str(tmp_path), ("e", "p"), 8, 5, make).count() == 3 and len(made) == 3


def test_top_lines(spark):
    scores = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (9, 2.0), (4, None)], "group_id long, score double")
    lines = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (4, "d")], "line long, text string")
    got = T.top_lines(scores, lines, 3).orderBy("place").select("group_id", "place", "text").collect()
    assert [tuple(r) for r in got] == [(1, 1, "b"), (2, 2, "c"), (9, 3, None)]
    assert T.top_lines(scores.limit(0), lines, 3).count() == 0


def test_parameter_scopes(spark):
    with pytest.raises(ValueError, match="unknown scope"):
        X.classify(F.lit("a"), scope="mlp")
    names = ["layers.1.self_attn.v_proj.weight", "mylayers.1.self_attn.v_proj.weight", "block.12.mlp.down_proj.weight", None]
    df = spark.createDataFrame([(n, [2, 2]) for n in names], "n string, s array<int>")
    got = df.select(*(c.alias(k) for k, c in X.classify(F.col("n"), F.col("s")).items())).collect()
    assert [tuple(r) for r in got] == [(1, "V"), (None, None), (12, "DOWN"), (None, None)]
    flat = df.select(X.classify(F.col("n"), F.array(F.lit(2)))["family"].alias("f"))
    assert flat.where("f is not null").count() == 0


def test_first_truth(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(A.first_hash_answer(F.col("t")).alias("a")).first()["a"]
    assert one("#### x\n#### -1,200\n#### 3") == "-1200"
    with pytest.raises(Exception, match="no #### answer"):
        one("####5")
