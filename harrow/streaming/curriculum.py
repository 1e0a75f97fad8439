"""A curriculum sampler: prompts weigh what can be learned from them, by the results that arrive.

A prompt's success is a moving average: each result moves it by a share ``rate``, from 0.5 at the start. Its weight is
success times failure plus ``floor``, so that no prompt is lost; one without results weighs 0.25 plus ``floor``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harrow.functions.expressions import fraction
from harrow.operators.select import top

START = 0.5
SCHEMA = "prompt string, seen long, success double, weight double"


class CurriculumState(StatefulProcessor):
    """A prompt's number of results and success, two numbers of state. Results of one batch count in order of seq."""

    def __init__(self, rate: float, floor: float):
        self.rate, self.floor = rate, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("success", "seen long, success double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, success = self.state.get() if self.state.exists() else (0, START)
        for _, result in sorted((int(s), float(r)) for part in rows for s, r in zip(part["seq"], part["result"], strict=True) if r == r):
            seen, success = seen + 1, success + self.rate * (result - success)
        self.state.update((seen, success))
        yield pd.DataFrame({"prompt": [key[0]], "seen": [seen], "success": [success], "weight": [success * (1 - success) + self.floor]})

    def close(self) -> None:
        pass


def updates(stream: DataFrame, rate: float = 0.1, floor: float = 0.01) -> DataFrame:
    """Streaming (prompt, seen, success, weight) of a stream of (prompt, seq, result): a prompt's new row whenever results
    of it have come. Null results don't count."""
    return stream.groupBy("prompt").transformWithStateInPandas(CurriculumState(rate, floor), SCHEMA, "Update", "None")


def weights(results: DataFrame, rate: float = 0.1, floor: float = 0.01) -> DataFrame:
    """What ``updates`` ends with, of a table of all results."""
    known = results.where("result is not null and not isnan(result)")
    back = F.row_number().over(W.partitionBy("prompt").orderBy(F.desc("seq"), F.desc("result"))) - 1
    share = F.pow(F.lit(1 - rate), "__back")
    got = known.withColumn("__back", back).groupBy("prompt").agg(F.count("*").alias("seen"), (F.sum(share * rate * F.col("result")) + START * F.pow(F.lit(1 - rate), F.count("*"))).alias("success"))
    whole = results.select("prompt").distinct().join(got, "prompt", "left").select("prompt", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("success", F.lit(START)).alias("success"))
    return whole.withColumn("weight", F.col("success") * (1 - F.col("success")) + floor)


def latest(rows: DataFrame) -> DataFrame:
    """One row per prompt from a table that updates were appended to: that with the most results."""
    return rows.groupBy("prompt").agg(F.max_by(F.struct("seen", "success", "weight"), "seen").alias("r")).select("prompt", "r.*")


def drawn(prompts: DataFrame, n: int, step: int, seed: int = 0, key: str = "prompt", weight: Column | str = "weight") -> DataFrame:
    """``n`` different prompts, each next one with a chance that is its share of the weight left: those with the least
    exponential waiting times. A step's draws are the same on every run; without weight nothing is drawn."""
    w = F.col(weight) if isinstance(weight, str) else weight
    wait = -F.log(1 - fraction(f"{seed}.{step}", F.col(key))) / w
    return top(prompts.where(w > 0).withColumn("__wait", wait), n, ["__wait", key]).drop("__wait")
