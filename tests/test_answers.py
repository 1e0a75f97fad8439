"""Graders on their known cases."""

import pytest
from pyspark.sql import functions as F

from harrow.functions import answers as A
from harrow.functions import rewards as R


@pytest.mark.parametrize(
    ("text", "truth", "acc", "invalid"),
    [
        (r"Adding both gives \boxed{305}.", "305", True, False),
        ("So, the answer is 305.", "305", True, False),
        (r"\boxed{19}" + " which can be checked" * 30, "19", True, False),
        (r"It is \boxed{\frac{15}{25}} in the end.", r"\frac{3}{5}", True, False),
        (r"I get \boxed{304} here.", "305", False, False),
        ("I could not finish.", "305", False, True),
    ],
)
def test_verified(spark, text, truth, acc, invalid):
    r = spark.createDataFrame([(text, truth)], "r string, t string").select(R.verified("r", "t").alias("v")).first()["v"]
    assert (r["acc"], r["invalid"]) == (acc, invalid)


def test_countdown():
    cases = {r"\boxed{(25-4)*7=147}": None, r"\boxed{7*(25-4)}": None, r"\boxed{25*7-4}": "value", r"\boxed{25-4=21}": "numbers", r"\boxed{(25-4)*7=150}": "sides differ", r"\boxed{25-4*7)}": "no value", "147": "no expression"}
    assert {x: A.countdown(x, [4, 7, 25], 147) for x in cases} == cases
    assert A.arithmetic("1" + "+1" * 600) == 601
    assert A.arithmetic("__import__('os')") is None and A.arithmetic("1/0") is None


def test_boxes_and_equality():
    assert A.boxed_in(r"\boxed{a{b}c} \boxed{open") == "a{b}c"
    assert A.boxed_in(r"\boxed{a} \boxed{open", strict=True) is None
    assert A.same_answer("1,000", "1000") and A.same_answer("50%", "0.5") and A.same_answer("(1, 2)", "(1,2)") and A.same_answer("1/2", r"\dfrac{1}{2}")
    assert not A.same_answer("3", "4") and not A.same_answer(None, "4")
    assert A.json_in('x {"a": """b\nc"""} y') == {"a": "b\nc"}
    assert A.bleu("abcde", "abcde") == pytest.approx(1) and A.bleu("abcde", "xyz") == 0
    like = " ".join(f"sentence number {i} of the list says that {i * 7919 % 10007} is not {i * 104729 % 9973} and then some more words follow." for i in range(150))
    assert not A.repeats_itself(like)  # much alike, yet its common prefixes are short
    assert A.repeats_itself("abc" * 200) and not A.repeats_itself("the quick brown fox jumps over")
    assert A.tool_messages("think <code>\n```python\nx = 1\n```</code>\n<interpreter> 1\n</interpreter> so <answer>\\boxed{1}</answer> \n") == ([("assistant", "think", "x = 1"), ("tool", "1", None), ("assistant", "so \\boxed{1}", None)], None)
    assert A.tool_messages("<code>y</code>") == ([("assistant", "", "y")], None) and A.tool_messages(" ") == ([], None)
    assert A.tool_messages("<code>y</code> no") == ([("assistant", "", "y")], "the tool has no turn")
    assert A.tool_messages("a</answer><answer>b</answer>")[1] == A.tool_messages("<answer>b")[1] == "<answer> is not closed"


def test_columns(spark):
    df = spark.createDataFrame([("so #### 1,234", r"x \boxed{5}", "Answer: B\n", "<answer>The Cat!</answer>", "```python\nx\n```")], "h string, b string, c string, q string, f string")
    r = df.select(A.hash_answer(F.col("h")).alias("h"), A.boxed_flat(F.col("b")).alias("b"), A.choice_letter(F.col("c")).alias("c"), A.qa_normal(A.tagged(F.col("q"))).alias("q"), A.code_fence(F.col("f")).alias("f")).first()
    assert tuple(r) == ("1234", "5", "B", "cat", "x\n")
    scores = spark.createDataFrame([("gsm8k", "#### 5", "5"), ("math", r"\boxed{5.0}", "5"), ("gpqa", "Answer: A", "B"), ("aime", "Answer: 7", "7"), ("search_qa", "<answer>a cat</answer>", "Cat")], "s string, r string, t string")
    assert [x[0] for x in scores.select(R.dispatch(F.col("s"), F.col("r"), F.col("t"))).collect()] == [1.0, 1.0, 0.0, 1.0, 1.0]
