"""Arithmetic tasks with an operator of their own, a @ b = 3a - 2b: generation from a seed, and the answers' evaluator.

An expression is some terms joined by operators; a term is a number or, down to a depth, an expression in parentheses.
Every choice is a fraction of a hash of seed, row and place in the expression, so a row's expression doesn't depend on
other rows or on partitions, and a retried task makes it again. The grammar is unrolled into one column, depth by depth.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "@": 3}
OPERATORS = {"@": 1.0}
PROMPT = "The operator @ is new and only a tool can compute it. Put the final answer inside \\boxed{} in the last turn alone. Compute "


def fraction(seed: int | str, key: Column, place: str = "") -> Column:
    """A number of [0, 1) from the first 32 bits of a hash of seed, key and place."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{place}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def expression(key: Column, seed: int = 0, terms: tuple[int, int] = (2, 3), numbers: tuple[int, int] = (1, 10), depth: int = 1, nested: float = 0.5, operators: dict[str, float] | None = None, decimals: bool = False) -> Column:
    """The expression of a row with that key; numbers are of [first, last), with up to two decimals if ``decimals``."""
    (least, most), (low, high) = terms, numbers
    if not 1 <= least <= most or not low < high:
        raise ValueError("terms need 1 <= least <= most and numbers low < high")
    weights = {k: w for k, w in (operators or OPERATORS).items() if w > 0}
    if not weights or not set(weights) <= set(RANK):
        raise ValueError(f"operators are some of {sorted(RANK)}, with positive weights")

    def number(place: str) -> Column:
        x = low + fraction(seed, key, f"{place}n") * (high - low)
        if not decimals:
            return F.floor(x).cast("string")
        places = F.floor(fraction(seed, key, f"{place}d") * 3).cast("int")
        return F.when(places == 0, F.format_string("%.0f", x)).when(places == 1, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))

    def operator(place: str) -> Column:
        at, upto, out = fraction(seed, key, f"{place}o") * sum(weights.values()), 0.0, None
        for name, w in weights.items():
            upto += w
            out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
        return out.otherwise(name)

    def whole(place: str, level: int) -> Column:
        n = least + F.floor(fraction(seed, key, f"{place}k") * (most - least + 1))
        parts = [term(f"{place}0", level)]
        parts += [F.when(n > i, F.concat(F.lit(" "), operator(f"{place}{i}"), F.lit(" "), term(f"{place}{i}", level))).otherwise("") for i in range(1, most)]
        return F.concat(*parts)

    def term(place: str, level: int) -> Column:
        if level >= depth:
            return number(place)
        return F.when(fraction(seed, key, f"{place}p") < nested, F.concat(F.lit("("), whole(f"{place}.", level + 1), F.lit(")"))).otherwise(number(place))

    return whole("", 0)


def evaluate(text: str) -> int | float | None:
    """The value, as an integer if it is whole. @ binds tightest, then * and /, then + and -, each from the left.
    None for unknown characters, a sign without a left side, unbalanced parentheses, division by zero or no finite value."""
    found = re.findall(r"[0-9.]+|[-+*/@()]|\s+|.", text, re.S)
    values: list[float] = []
    waiting: list[str] = []

    def apply() -> None:
        op, b, a = waiting.pop(), values.pop(), values.pop()
        values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b if op == "/" else 3 * a - 2 * b)

    try:
        for t in found:
            if t.isspace():
                continue
            if t in RANK:
                while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[t]:
                    apply()
                waiting.append(t)
            elif t == "(":
                waiting.append(t)
            elif t == ")":
                while waiting[-1] != "(":
                    apply()
                waiting.pop()
            else:
                values.append(float(t))
        while waiting:
            if waiting[-1] == "(":
                return None
            apply()
    except (IndexError, ValueError, ZeroDivisionError):
        return None
    if len(values) != 1 or not math.isfinite(values[0]):
        return None
    return int(values[0]) if values[0].is_integer() else values[0]


@F.pandas_udf(T.StringType())
def value_text(text: pd.Series) -> pd.Series:
    """The value as it is written, null if there is none."""
    return text.map(lambda t: None if t is None or (v := evaluate(t)) is None else str(v))


def tasks(df: DataFrame, key: str, **how) -> DataFrame:
    """Adds expression, answer, tool_calls (operators but division) and prompt. Where an expression divides by zero the
    answer is null; ``where("answer is not null")`` leaves the tasks."""
    own = df.withColumn("expression", expression(F.col(key), **how))
    return own.withColumns({"answer": value_text("expression"), "tool_calls": F.length("expression") - F.length(F.translate("expression", "+-*@", "")), "prompt": F.concat(F.lit(PROMPT), F.col("expression"))})
