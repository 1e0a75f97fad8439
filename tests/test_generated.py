"""Masks of turns, generators, curricula and expression tasks against plain versions."""

import pathlib
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harrow.functions import answers as A
from harrow.functions import expressions as E
from harrow.operators import chat, generate, metrics
from harrow.streaming import curriculum

# ---- chats ------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, flag int"


def plain_parts(rows):
    """(role, messages, tokens, mask) of one chat's rows in order."""
    out, i = [], 0
    while i < len(rows):
        end = i + 1
        while rows[i][2] == "tool" and end < len(rows) and rows[end][2] == "tool":
            end += 1
        _, _, role, _, flag = rows[i]
        body = [w for r in rows[i:end] for w in (r[3] or "").split()]
        mask = [0] + [int(role == "assistant")] * (len(body) + 1)
        out.append((role, end - i, [f"<|{role}|>", *body, chat.END], mask if flag is None else [flag] * len(mask)))
        i = end
    return out


def test_turns(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        roles = [rng.choice(chat.ROLES) for _ in range(rng.randint(1, 9))]
        rows += [(conv, k, role, rng.choice([None, "", "a", "b  c\nd", "x y"]), rng.choice([None, None, 0, 1])) for k, role in enumerate(roles)]
    want = {c: plain_parts([r for r in rows if r[0] == c]) for c in range(40)}
    df = spark.createDataFrame(rng.sample(rows, len(rows)), CHAT)
    got = chat.parts(df, override="flag")
    assert {(r.conv_id, r.part): (r.role, r.messages, r.tokens, r["mask"]) for r in got.collect()} == {(c, k): p for c, ps in want.items() for k, p in enumerate(ps)}
    whole = {r.conv_id: (r.tokens, r["mask"]) for r in chat.folded(got).collect()}
    assert whole == {c: ([t for p in ps for t in p[2]], [m for p in ps for m in p[3]]) for c, ps in want.items()}
    assert chat.parts(df.limit(0)).collect() == [] and chat.faults(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("roles", "flags", "fault"),
    [
        ("user assistant", {}, None),
        ("system user assistant tool tool assistant", {3: 1}, None),
        ("system user", {}, "the beginning is not user, assistant"),
        ("user user assistant", {}, "the beginning is not user, assistant"),
        ("assistant", {}, "the beginning is not user, assistant"),
        ("user", {}, "the beginning is not user, assistant"),
        ("user assistant system critic", {}, "a system message after the first"),
        ("user assistant critic system", {}, "unknown role critic"),
        ("user assistant None", {}, "unknown role null"),
        ("user assistant tool tool", {3: 7}, None),  # only a part's first flag is read
        ("user assistant tool tool", {2: 7}, "a mask other than 0 or 1"),
    ],
)
def test_chat_faults(spark, roles, flags, fault):
    rows = [(1, k, None if r == "None" else r, "t", flags.get(k)) for k, r in enumerate(roles.split())]
    got = chat.faults(spark.createDataFrame(rows, CHAT), override="flag").collect()
    assert [r.fault for r in got] == ([fault] if fault else [])


# ---- generators -------------------------------------------------------------------------------------


def test_generators(spark):
    rows = [("a", 3, "z"), ("a", 1, "x"), ("a", 2, None), ("b", 1, "only"), (None, 5, "n"), (None, 6, "m")]
    df = spark.createDataFrame(rows, "k string, id long, text string")
    first = generate.appended(df, generate.First, ["k"], ["id"])
    assert Counter(tuple(r) for r in first.collect()) == Counter([(*r, False) for r in rows] + [("a", 1, "x", True), ("b", 1, "only", True), (None, 5, "n", True)])
    made = generate.appended(df, generate.chained("id", "text", "-", 100), ["k"], ["id"], F.length("text") < 4).where("made").drop("made")
    assert sorted(map(tuple, made.collect()), key=str) == [("a", 103, "x-z"), (None, 106, "n-m")]
    again = generate.generated(made, generate.First, ["k"], ["id"])
    assert again.count() == 2 and generate.generated(df.limit(0), generate.First, ["k"], ["id"]).collect() == []


# ---- curriculum -------------------------------------------------------------------------------------


def plain_weights(rows, rate=0.1, floor=0.01):
    out = {}
    for p in {r[0] for r in rows}:
        seen, s = 0, 0.5
        for _, _, x in sorted(r for r in rows if r[0] == p and r[2] is not None):
            seen, s = seen + 1, s + rate * (x - s)
        out[p] = (seen, s, s * (1 - s) + floor)
    return out


def test_curriculum_stream(spark, tmp_path):
    """State over several batches ends where the table of all results does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 5)}", i, rng.choice([0.0, 1.0, 0.5, None])) for i in range(60)] + [("none", 60, None)]
    df = spark.createDataFrame(rows, "prompt string, seq long, result double")
    for a, b in ((0, 20), (20, 45), (45, 99)):
        df.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = curriculum.updates(stream).writeStream.format("memory").queryName("curriculum").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = plain_weights(rows)
    for table in (curriculum.latest(spark.table("curriculum")), curriculum.weights(df)):
        got = {r.prompt: (r.seen, r.success, r.weight) for r in table.collect()}
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_draws(spark):
    """First draws follow the weights; a step repeats, steps differ, and rows without weight are never drawn."""
    weights = {"a": 1.0, "b": 2.0, "c": 5.0, "d": 0.0, "e": None}
    df = spark.createDataFrame(list(weights.items()), "prompt string, weight double")
    wait = lambda step: -F.log(1 - E.fraction(f"0.{step}", F.col("prompt"))) / F.col("weight")
    steps = 2000
    first = df.where("weight > 0").select(*(F.min_by("prompt", wait(s)).alias(f"s{s}") for s in range(200))).first()
    assert [curriculum.drawn(df, 1, s).first().prompt for s in range(3)] == list(first[:3])
    many = df.where("weight > 0").crossJoin(spark.range(steps)).withColumn("w", -F.log(1 - E.fraction("0", F.concat("prompt", F.lit("/"), "id"))) / F.col("weight")).groupBy("id").agg(F.min_by("prompt", "w").alias("p"))
    n = Counter(r.p for r in many.collect())
    for p in "abc":
        q = weights[p] / 8
        assert abs(n[p] - steps * q) < 4 * (steps * q * (1 - q)) ** 0.5
    assert {r.prompt for r in curriculum.drawn(df, 10, 1).collect()} == {"a", "b", "c"}


# ---- expressions ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "value"),
    [("7@1", 19), ("2*6@4", 20), ("6@4*2", 20), ("1+2@3-4", -3), ("9 @ 2 @ 5", 59), ("2@(9-4)", -4), ("(8@1)/4", 5.5), ("1.5+.5", 2), ("7/2*2", 7), ("8/(2-2)", None), ("(1", None), ("1)", None), ("-3", None), ("1 2", None), ("1.2.3", None), ("2x3", None), ("", None), ("()", None), ("4@", None)],
)
def test_evaluate(text, value):
    got = E.evaluate(text)
    assert got == value and type(got) is type(value)


def test_generated_expressions(spark):
    """Every expression is of the grammar; its value is that of Python with @ spelled out; choices follow their weights."""

    class Own:
        def __init__(self, x):
            self.x = x

        __add__ = lambda a, b: Own(a.x + b.x)
        __sub__ = lambda a, b: Own(a.x - b.x)
        __mul__ = lambda a, b: Own(a.x * b.x)
        __truediv__ = lambda a, b: Own(a.x / b.x)
        __pow__ = lambda a, b: Own(3 * a.x - 2 * b.x)

    import re

    how = {"seed": 5, "terms": (2, 4), "numbers": (1, 20), "depth": 2, "operators": {"+": 1, "-": 1, "*": 1, "/": 1, "@": 2}}
    df = spark.range(1500).repartition(3)
    rows = E.tasks(df, "id", **how).collect()
    assert rows and {r.id: r.expression for r in rows} == {r.id: r.expression for r in E.tasks(df.coalesce(1), "id", **how).collect()}
    for r in rows:
        assert re.fullmatch(r"[0-9+\-*/@() ]+", r.expression) and 1 <= max(map(int, re.findall(r"\d+", r.expression))) < 20
        assert r.tool_calls == sum(r.expression.count(c) for c in "+-*@")
        # ** is of the right, so only expressions where no two @ follow each other are compared
        if not re.search(r"@ (\d+|\([^()]*\)) @|\) @|@ \(", r.expression):
            try:
                want = eval(re.sub(r"\d+", r"Own(\g<0>)", r.expression.replace("@", "**")), {"Own": Own}).x
            except ZeroDivisionError:
                want = None
            assert (r.answer is None) == (want is None) and (want is None or float(r.answer) == pytest.approx(want))
    flat = E.tasks(df, "id", seed=1, terms=(2, 2), depth=0, operators={"+": 1, "@": 3}).collect()
    n = Counter(r.expression.split()[1] for r in flat)
    assert set(n) == {"+", "@"} and abs(n["@"] - 1125) < 4 * (1500 * 0.1875) ** 0.5
    assert any("(" in e and e.count("(") > 1 for e in (r.expression for r in rows))
    decimal = [r.expression for r in E.tasks(df, "id", seed=2, decimals=True).limit(300).collect()]
    assert {len(x.split(".")[1]) if "." in x else 0 for e in decimal for x in re.findall(r"[\d.]+", e)} == {0, 1, 2}
    with pytest.raises(ValueError):
        E.expression(F.col("id"), operators={"%": 1})
    with pytest.raises(ValueError):
        E.expression(F.col("id"), numbers=(3, 3))


# ---- answers and metrics ----------------------------------------------------------------------------


def test_marked_answers():
    cases = {
        "Thus the answer is 12": (True, "12"),
        "Answer: x = 5. It was asked for": (True, "5"),
        "After all 4 is the answer": (True, "After all 4"),
        "the answers are 1, 2": (True, "1, 2"),
        r"first 3, then \boxed{\frac{1}{2}}": (True, r"\frac{1}{2}"),
        "the answer is seven": (False, "seven"),
        "17": (False, "17"),
        "": (False, ""),
    }
    assert {t: A.marked_answer(t) for t in cases} == cases


def test_matrices_and_lists():
    m = r"\begin{pmatrix} 1 & 0.5 \\ -3 & 4 \end{pmatrix}"
    for same in ("[[1, 1/2], [-3, 4]]", "Matrix([[1, 0.5], [-3, 4.0]])", r"$\begin{bmatrix}1&\frac{1}{2}\\-3&4\end{bmatrix}$"):
        assert A.same_answer(same, m) and A.same_answer(m, same)
    for other in ("[[1, 0.5], [-3, 5]]", "[[1, 0.5, -3, 4]]", "[[1, 0.5], [-3]]", "[1, 0.5]", "[]", "Matrix()"):
        assert not A.same_answer(other, m)
    assert A.parts_of("(1,000, 2)") == ["1000", "2"] and A.parts_of("[a, b)") == ["a", "b"] and A.parts_of("1,234") == ["1234"] and A.parts_of("((1),2)") == ["((1),2)"]
    assert A.any_same("so the answer is 50%", ["1", "0.5"]) and A.any_same(r"\boxed{(1,2)}", ["(1, 2)"])
    assert not A.any_same("3", ["4", None]) and not A.any_same(None, ["4"]) and not A.any_same("3", None) and not A.any_same("3", [])


def test_sequence_metrics(spark):
    schema = "score double, reward double, advantages array<double>, returns array<double>, values array<double>, mask array<int>, response_length long, prompt_length long"
    rows = [(1.0, 0.5, [1.0, -1.0, 9.0], [2.0, 4.0, 9.0], [1.0, 4.0, 0.0], [1, 1, 0], 2, 3), (7.0, 7.0, [5.0], [5.0], [5.0], [0], 0, 4), (3.0, 2.5, [3.0], [6.0], [5.0], [1], 1, 2)]
    df = spark.createDataFrame(rows, schema)
    got = {r.metric: r.value for r in metrics.sequence_metrics(df, 2, 4).collect()}
    assert got["critic/score/mean"] == 2.0 and got["critic/score/max"] == 3.0 and got["critic/rewards/min"] == 0.5
    assert got["critic/advantages/mean"] == 1.0 and got["critic/returns/max"] == 6.0 and got["critic/values/min"] == 1.0
    assert got["critic/vf_explained_var"] == pytest.approx(1 - (1 / 3) / (4 + 1e-5))
    assert got["response_length/mean"] == 1.0 and got["response_length_non_aborted/mean"] == 1.5 and got["response/aborted_ratio"] == pytest.approx(1 / 3)
    assert got["response_length_non_aborted/clip_ratio"] == 0.5 and got["prompt_length/clip_ratio"] == pytest.approx(1 / 3) and len(got) == 29
    assert len(metrics.sequence_metrics(df.drop("values"), 2, 4, values=False).collect()) == 25
    for none in (df.where("response_length = 0"), df.limit(0)):
        with pytest.raises(PySparkException, match="no sequence of the batch has a response"):
            metrics.sequence_metrics(none, 2, 4).collect()


def test_records_are_not_stored(spark):
    """Lines of records are made and read in one task; absent fields are null, and the parse isn't repeated for each check."""
    from harrow.plans import catalog, generated
    from harrow.sources.tables import shared_dir

    top = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(top.iterdir())
    got = catalog.queries()["record_faults"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and set(top.iterdir()) == before
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    one = generated._records(spark, "/root/testdata/sf0.001").first()
    assert one["subspace_similarity"] is None and one["group_stats"]["subspace_score"] is None and one["group_stats"]["rewards"]
