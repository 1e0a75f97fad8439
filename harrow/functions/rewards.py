"""Scoring of responses: by source, with the fields that each family returns, and without repeating work."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions import answers as A

#: Data source -> (response, truth) -> score.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(*sources: str) -> Callable:
    def add(fn: Callable) -> Callable:
        for s in sources:
            if s in SCORERS:
                raise ValueError(f"a scorer for {s!r} exists already")
            SCORERS[s] = fn
        return fn

    return add


@scorer("gsm8k", "openai/gsm8k")
def gsm8k(response: Column, truth: Column) -> Column:
    return F.when(A.hash_answer(response) == truth, 1.0).otherwise(0.0)


@scorer("math", "hendrycks_math", "geometry3k")
def math(response: Column, truth: Column) -> Column:
    return A.answers_equal(A.boxed(response), truth).cast("double")


@scorer("dapo", "aime")
def dapo(response: Column, truth: Column) -> Column:
    """1 or -1 by the normalized answer line of the last 300 characters."""
    given = A.minerva_normal(F.coalesce(A.answer_line(F.right(response, F.lit(300))), F.lit("[INVALID]")))
    return F.when(given == A.minerva_normal(truth), 1.0).otherwise(-1.0)


@scorer("gpqa")
def choice(response: Column, truth: Column) -> Column:
    return F.when(A.choice_letter(response) == truth, 1.0).otherwise(0.0)


@scorer("search_qa")
def qa(response: Column, truth: Column) -> Column:
    """1 for the tagged answer, a quarter where there are more than ten answer tags."""
    right = A.qa_normal(A.tagged(response)) == A.qa_normal(truth)
    many = (A.count_of(response, "<answer>") > 10) | (A.count_of(response, "</answer>") > 10)
    return F.when(right & many, 0.25).when(right, 1.0).otherwise(0.0)


@scorer("char_count")
def char_count(response: Column, truth: Column) -> Column:
    return F.when(A.boxed_flat(response) == truth, 1.0).otherwise(0.0)


@scorer("countdown")
def countdown(response: Column, problem: Column) -> Column:
    """1 for a boxed expression that uses each number of the problem once and makes its target; 0 for others, and for a
    problem that states neither."""
    listed = F.coalesce(F.nullif(F.regexp_extract(problem, r"Given the numbers \[(.*?)\],", 1), F.lit("")), F.regexp_extract(problem, "Given the numbers (.*?), find", 1))
    numbers = F.transform(F.split(listed, ","), lambda x: F.trim(x).try_cast("int"))
    target = F.regexp_extract(problem, "reach the target ([0-9]+)", 1).try_cast("int")
    stated = F.coalesce(target.isNotNull() & F.forall(numbers, lambda x: x.isNotNull()), F.lit(False))
    # the function runs on all rows of a dispatch; a null text passes it at once
    reason = A.countdown_reason(F.when(stated, response), numbers, target)
    return F.when(stated & response.isNotNull() & reason.isNull(), 1.0).otherwise(0.0)


def dispatch(source: Column, response: Column, truth: Column, strict: bool = True) -> Column:
    """The score by the row's source; an unknown source is an error, or null if not ``strict``. Python functions run on all rows
    of a dispatch, so a scorer gets nulls for the rows of other sources, which pass it at once."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double") if strict else F.lit(None).cast("double")
    named: dict[Callable[[Column, Column], Column], list[str]] = {}
    for name, fn in SCORERS.items():
        named.setdefault(fn, []).append(name)
    for fn, names in named.items():
        own = source.isin(*names)
        out = F.when(own, fn(F.when(own, response), F.when(own, truth))).otherwise(out)
    return out


_VERIFIED = T.StructType().add("acc", T.BooleanType()).add("pred", T.StringType()).add("reward", T.DoubleType()).add("verifier", T.StringType()).add("status", T.StringType()).add("invalid", T.BooleanType()).add("verification_error", T.BooleanType())


@F.pandas_udf(_VERIFIED)
def verified(response: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """Boxed answers that are equal after normalization, or as numbers; the last number of an answer sentence
    where nothing is boxed. An empty truth can't be verified."""
    import re

    rows = []
    for r, t in zip(response, truth, strict=True):
        if not t:
            rows.append((False, None, -1.0, "none", "empty_truth", False, True))
            continue
        given = A.boxed_in(r or "")
        if given is None and (m := re.findall(r"(?i)answer is:?\s*(-?[^\s]+?)[.\s]*(?:\n|$)", r or "")):
            given = m[-1]
        same = given is not None and A.same_answer(given, t)
        rows.append((same, given, 1.0 if same else -1.0, "rule", "ok" if given is not None else "no_answer", given is None, False))
    return pd.DataFrame(rows, columns=_VERIFIED.names)


def step_score(response: Column, truth: Column) -> Column:
    """(correct, format, answer): the boxed answer against the truth; in format is what has a second step and a box,
    or is right."""
    answer = A.boxed_or_spaced(response)
    right = F.coalesce(A.answers_equal(answer, truth), F.lit(False))
    form = F.contains(response, F.lit("Step 2:")) & F.contains(response, F.lit("\\box"))
    return F.struct(right.alias("correct"), (right | F.coalesce(form, F.lit(False))).alias("format"), answer.alias("answer"))


def coalesced(score: Column, passed: Column, correct: Column) -> Column:
    """The score, else 1 or 0 by passed, else by correct; not a number is null."""
    got = F.coalesce(score, passed.cast("int").cast("double"), correct.cast("int").cast("double"))
    return F.when(~F.isnan(got) & (F.abs(got) != float("inf")), got)


def input_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def rescored(df: DataFrame, score: Column, key: Column, name: str, version: str) -> DataFrame:
    """Rows whose stored name, version and input hash are the current ones keep their score; others are
    scored anew. ``df`` has reward_score, reward_name, reward_version and reward_input; the scored part alone runs the function."""
    same = F.col("reward_name").eqNullSafe(F.lit(name)) & F.col("reward_version").eqNullSafe(F.lit(version)) & F.col("reward_input").eqNullSafe(key)
    old = df.where(same).withColumn("rescored", F.lit(False))
    new = df.where(~same).withColumns({"reward_score": score, "reward_name": F.lit(name), "reward_version": F.lit(version), "reward_input": key, "rescored": F.lit(True)})
    return old.unionByName(new)


def at_last_token(score: Column, length: Column) -> Column:
    """Per token: 0, and the score on the last valid one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1)).cast("int")), lambda i: F.when(i == length, score).otherwise(0.0))


def pass_rate(results: Column, first: int | None = 10) -> Column:
    """Share of passed cases among the first ones."""
    own = F.slice(results, 1, first) if first else results
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda x: x)) / F.size(own)).otherwise(0.0)


def multi_turn(messages: Column, truth: Column) -> Column:
    """The score of the last assistant message."""
    return gsm8k(F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"], truth)


def weighted(df: DataFrame, weights: dict[str, float], row: str, metric: str = "metric", score: str = "score") -> DataFrame:
    """(row, reward): scores over repeats times weight over repeats, held to [-1, 1], summed over metrics."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col(metric)]
    each = df.where(F.col(metric).isin(*weights)).groupBy(row, metric).agg((F.sum(score) * F.max(w) / F.count("*")).alias("s"))
    return each.groupBy(row).agg(F.sum(F.greatest(F.least("s", F.lit(1.0)), F.lit(-1.0))).alias("reward"))
