"""Reward managers and scorers that are Python functions."""

import time

import pytest
from pyspark.sql import functions as F

from harrow.functions import managers as G
from harrow.functions import rewards as R

SCHEMA = "source string, response string, truth string, length long, width int"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA).coalesce(1)


def test_registry(spark):
    assert {"naive", "batch", "prime", "dapo"} <= set(G.MANAGERS)
    G.manager("naive")(G.naive)
    with pytest.raises(ValueError, match="exists already"):
        G.manager("naive")(G.dapo)
    with pytest.raises(ValueError, match="unknown manager"):
        G.managed("none", rows(spark, ("math", "", "", 0, 0)))


def test_tokens_and_given_rewards(spark):
    df = rows(spark, ("gsm8k", "#### 5", "5", 2, 3), ("gsm8k", "#### 5", "5", 0, 3), ("gsm8k", "#### 5", "6", 3, 3), ("gsm8k", "", "6", 0, 0))
    assert [r["token_rewards"] for r in G.naive(df).collect()] == [[0, 1, 0], [0, 0, 1], [0, 0, 0], []]
    given = df.withColumn("model_rewards", F.when(F.col("length") == 2, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.0))))
    assert [r["token_rewards"] for r in G.naive(given).collect()][:2] == [[0.5, 0.25, 0], [0, 0, 1]]


def test_dapo(spark):
    df = rows(spark, ("gsm8k", "#### 5", "5", 8, 10), ("gsm8k", "#### 5", "5", 6, 10), ("gsm8k", "#### 5", "1", 10, 10))
    got = G.dapo(df, most=10, buffer=4, factor=2.0, log=True).collect()
    assert [r["reward"] for r in got] == [0.0, 1.0, -2.0]
    assert [(r["extra"]["acc"], r["extra"]["overlong"]) for r in got] == [("1.0", "true"), ("1.0", "false"), ("0.0", "true")]
    assert [r["reward"] for r in G.dapo(df).collect()] == [1.0, 1.0, 0.0]
    own = F.struct(F.lit(0.5).alias("score"), F.col("truth").alias("pred"))
    assert [tuple(sorted(r["extra"].items())) for r in G.dapo(df, own).collect()][0] == (("pred", "5"), ("score", "0.5"))
    for bad in ({"buffer": 4}, {"buffer": 4, "most": 3}):
        with pytest.raises(ValueError, match="length that is not below"):
            G.dapo(df, **bad)


def test_batch(spark):
    df = rows(spark, ("a", "x", "x", 1, 2), ("b", "y", "x", 2, 2), ("c", None, None, 1, 1))

    def score(sources, responses, truths, scale):
        return [{"score": scale * (r == t), "acc": s == "b", "note": [s]} if s != "c" else -1 for s, r, t in zip(sources, responses, truths)]

    got = G.managed("batch", df, score, scale=3).collect()
    assert [(r["reward"], r["passed"], r["extra"].get("note")) for r in got] == [(3.0, False, '["a"]'), (0.0, True, '["b"]'), (-1.0, False, None)]
    assert [r["token_rewards"] for r in got] == [[3, 0], [0, 0], [-1]]
    with pytest.raises(Exception, match="1 scores for"):
        G.batch(df, lambda s, r, t: [1]).collect()
    with pytest.raises(Exception, match="dict without score"):
        G.batch(df, lambda s, r, t: [{"acc": True}] * len(s)).collect()
    assert G.batch(df.where("length > 9"), score, scale=1).count() == 0


def test_prime(spark):
    df = rows(spark, *((str(i), "r", "t", 1, 1) for i in range(8)))

    def score(source, response, truth):
        if source == "0":
            raise KeyError(source)
        if source == "1":
            time.sleep(3)
        return {"2": None, "3": True, "4": [0.25, "why"], "5": {"score": 0.75}, "6": float("nan")}.get(source, 2)

    got = {r["source"]: r["reward"] for r in G.prime(df, score, timeout=1.0, together=4).collect()}
    assert got == {"0": 0.0, "1": 0.0, "2": 0.0, "3": 1.0, "4": 0.25, "5": 0.75, "6": 0.0, "7": 2.0}

    async def later(source, response, truth):
        import asyncio

        await asyncio.sleep(5 if source == "1" else 0.01)
        return int(source)

    assert {r["source"]: r["reward"] for r in G.prime(df, later, timeout=1.0).collect()} == {str(i): 0.0 if i == 1 else float(i) for i in range(8)}


def test_module(spark, tmp_path):
    path = tmp_path / "reward.py"
    path.write_text("N = 0\n\ndef plain(r, t, bonus=0):\n    global N\n    N += 1\n    return {'score': float(r == t) + bonus, 'pred': r, 'n': N}\n\nasync def slow(r, t):\n    return 0.5\n\ndef bad(r, t):\n    return {}\n")
    df = rows(spark, ("a", "x", "x", 1, 1), ("b", "y", "x", 1, 1), ("c", "z", "z", 1, 1))
    plain = G.Module(str(path), "plain")
    path.write_text("")  # the text went with the plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = [r["s"] for r in df.select(G.loaded(plain, bonus=1)("response", "truth").alias("s")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # counted on through the batches of a task: the module ran once
    assert [(s["reward"], s["passed"], s["extra"]["pred"], s["extra"]["n"]) for s in got] == [(2.0, True, "x", "1"), (1.0, True, "y", "2"), (2.0, True, "z", "3")]
    assert len(plain.version) == 64
    path.write_text("async def slow(r, t):\n    return 0.5\n\ndef bad(r, t):\n    return {}\n")
    assert df.select(G.loaded(G.Module(str(path), "slow"))("response", "truth").alias("s")).first()["s"]["reward"] == 0.5
    with pytest.raises(Exception, match="without score"):
        df.select(G.loaded(G.Module(str(path), "bad"))("response", "truth")).collect()
    with pytest.raises(AttributeError, match="no function 'none'"):
        G.Module(str(path), "none")


def test_countdown(spark):
    cases = [
        ("\\boxed{(25-4)*7=147}", "Given the numbers [4, 7, 25], find a way to reach the target 147.", 1.0),
        ("\\boxed{(25-4)*7}", "Given the numbers 4, 7, 25, find a way to reach the target 147.", 1.0),
        ("\\boxed{(25-4)*7}", "Given the numbers [4, 7, 25], find a way to reach the target 148.", 0.0),
        ("\\boxed{1}", "Given the numbers [a, 7], find a way to reach the target 1.", 0.0),
        ("\\boxed{1}", "no problem", 0.0),
        (None, "Given the numbers [1], find a way to reach the target 1.", 0.0),
        ("\\boxed{1}", None, 0.0),
    ]
    df = spark.createDataFrame([(r, p) for r, p, _ in cases], "r string, p string")
    assert [x[0] for x in df.select(R.countdown(F.col("r"), F.col("p"))).collect()] == [w for _, _, w in cases]


def test_prime_takes_rows_without_a_task_each(spark):
    """Many fast calls cost little beside them; late calls that hold all places leave the rest at 0."""
    rows_ = [("a", str(i), "t") for i in range(20_000)]
    began = time.monotonic()
    assert G._in_threads(lambda r: float(r[1]), rows_, 5.0, 64) == [float(i) for i in range(20_000)]
    assert time.monotonic() - began < 0.5
    got = G._in_threads(lambda r: time.sleep(0.6) or 1.0 if int(r[1]) < 2 else float(r[1]), rows_[:6], 0.1, 2)
    assert got[:2] == [0.0, 0.0] and set(got[2:]) <= {0.0, 2.0, 3.0, 4.0, 5.0}
    df = spark.createDataFrame([("a", "r", "t", n, w) for n, w in ((1, 3), (3, 3), (5, 3), (0, 2), (0, 0), (-1, 2), (None, 2), (2, None))], SCHEMA).coalesce(1)
    assert [r["token_rewards"] for r in G.prime(df, lambda *_: 2).collect()] == [[2, 0, 0], [0, 0, 2], [0, 0, 0], [0, 2], [], [0, 2], [0, 2], []]
    plan = G.prime(df, lambda *_: 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_scorers_get_their_own_rows_alone(spark, monkeypatch):
    """A scorer's Python function gets no text of rows of other sources, and its names share one call."""

    @F.pandas_udf("double")
    def strict(response, truth):
        bad = [r for r in response if r not in (None, "own")]
        assert not bad, bad
        return response.map(lambda r: None if r is None else 2.0).astype("float64")

    monkeypatch.setattr(R, "SCORERS", {**R.SCORERS, "mine": strict, "mine too": strict})
    df = rows(spark, ("mine", "own", "t", 1, 1), ("math", "\\boxed{3}", "3", 1, 1), ("gsm8k", "#### 4", "5", 1, 1), ("mine too", "own", "t", 1, 1), ("geometry3k", None, "3", 1, 1))
    got = G.naive(df)
    assert [r["reward"] for r in got.collect()] == [2.0, 1.0, 0.0, 2.0, 0.0]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[strict(") == 1
    with pytest.raises(Exception, match="no scorer for other"):
        G.naive(rows(spark, ("other", "", "", 1, 1))).collect()
