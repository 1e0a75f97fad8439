"""Reward managers: how a batch of responses gets its scores, and what becomes of them.

A manager takes rows with ``source``, ``response``, ``truth``, ``length`` (valid tokens of the response) and ``width`` (all of
them) and adds ``reward``, ``extra`` (a map of what else the scorer said) and ``token_rewards``: the reward on the last valid
token, 0 elsewhere; where none is valid, on the last one. Rows with ``model_rewards`` given have these as they are.
Names of managers are in :data:`MANAGERS`.
"""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import json
import math
import threading
import time
import types
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.answers import overlong_penalty
from harrow.functions.rewards import dispatch

Manager = Callable[..., DataFrame]
MANAGERS: dict[str, Manager] = {}


def manager(name: str) -> Callable[[Manager], Manager]:
    """Registers a manager; another one of the same name is an error."""

    def add(fn: Manager) -> Manager:
        if MANAGERS.get(name, fn) is not fn:
            raise ValueError(f"a manager named {name!r} exists already")
        MANAGERS[name] = fn
        return fn

    return add


def managed(name: str, df: DataFrame, *args: Any, **options: Any) -> DataFrame:
    if name not in MANAGERS:
        raise ValueError(f"unknown manager {name!r}; there are {', '.join(sorted(MANAGERS))}")
    return MANAGERS[name](df, *args, **options)


def on_last_token(reward: Column, length: Column, width: Column) -> Column:
    """An array of ``width`` (over 0) numbers. Zeros on both sides, which Spark compiles, unlike a function of each token."""
    at = F.when(length > 0, length).otherwise(width)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    return F.when(at <= width, F.concat(zeros(at - 1), F.array(reward), zeros(width - at))).otherwise(zeros(width))


def _finished(df: DataFrame) -> DataFrame:
    tokens = F.when(F.col("width") > 0, on_last_token(F.col("reward"), F.col("length"), F.col("width"))).otherwise(F.array().cast("array<double>"))
    if "model_rewards" in df.columns:
        tokens = F.coalesce("model_rewards", tokens)
    return df.withColumn("token_rewards", tokens)


def _parts(score: Column | None, df: DataFrame) -> tuple[Column, Column]:
    """Reward and map of extras of a score, which is a number or a struct with one."""
    value = dispatch(F.col("source"), F.col("response"), F.col("truth")) if score is None else score
    kind = df.select(value.alias("s")).schema["s"].dataType
    if not isinstance(kind, T.StructType):
        return value.cast("double"), F.create_map().cast("map<string,string>")
    extra = F.create_map(*(x for f in kind.names for x in (F.lit(f), value[f].cast("string"))))
    return value["score"].cast("double"), extra


@manager("naive")
def naive(df: DataFrame, score: Column | None = None) -> DataFrame:
    """A score per row by its source, or the given one; the fields of a struct are kept as extras."""
    reward, extra = _parts(score, df)
    return _finished(df.withColumns({"reward": reward, "extra": extra}))


@manager("dapo")
def dapo(df: DataFrame, score: Column | None = None, most: int | None = None, buffer: int | None = None, factor: float = 1.0, log: bool = False) -> DataFrame:
    """As naive, and a penalty for what enters the last ``buffer`` tokens before ``most``. A plain score is kept as acc, and
    with ``log`` the penalty too."""
    reward, extra = _parts(score, df)
    plain = F.map_concat(extra, F.create_map(F.lit("acc"), reward.cast("string")))
    extra = F.when(F.size(extra) == 0, plain).otherwise(extra)
    if buffer is None:
        return _finished(df.withColumns({"reward": reward, "extra": extra}))
    if most is None or most < buffer:
        raise ValueError("a buffer for long responses needs a length that is not below it")
    penalty = overlong_penalty(F.col("length"), most, buffer, factor)
    if log:
        extra = F.map_concat(extra, F.create_map(F.lit("overlong_reward"), penalty.cast("string"), F.lit("overlong"), (penalty < 0).cast("string")))
    return _finished(df.withColumns({"reward": reward + penalty, "extra": extra}))


# ---- scorers that are Python functions ---------------------------------------------------------------


def resolved(result: Any) -> tuple[float, bool, dict[str, str]]:
    """Score, whether passed (acc, else a score above 0), and the other fields of a dict; an awaitable is awaited. A dict
    without score is an error."""
    if inspect.isawaitable(result):
        result = asyncio.run(_awaited(result))
    if isinstance(result, dict):
        if "score" not in result:
            raise ValueError("the scorer returned a dict without score")
        score = float(result["score"])
        return score, bool(result.get("acc", score > 0)), {k: _plain(v) for k, v in result.items() if v is not None}
    return float(result), float(result) > 0, {}


async def _awaited(x: Any) -> Any:
    return await x


def _plain(x: Any) -> str:
    return x if isinstance(x, str) else json.dumps(x, default=str)


_RESULT = T.StructType([T.StructField("reward", T.DoubleType()), T.StructField("passed", T.BooleanType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


class Module:
    """A scorer from a Python file. Its text is read where the plan is made and goes with the plan, so that executors need no
    copy; a task runs it once. ``version`` is the text's digest."""

    def __init__(self, path: str, name: str) -> None:
        self.name, self.text = name, Path(path).read_text(encoding="utf-8")
        self.version = hashlib.sha256(self.text.encode()).hexdigest()
        if not callable(self.load()):
            raise AttributeError(f"{path} has no function {name!r}")

    def load(self) -> Callable | None:
        module = types.ModuleType(f"reward_{self.version[:16]}")
        exec(compile(self.text, module.__name__, "exec"), module.__dict__)  # noqa: S102
        return getattr(module, self.name, None)


Scorer = Callable | Module


def _callable(fn: Scorer) -> Callable:
    return fn.load() if isinstance(fn, Module) else fn


def loaded(fn: Module, **options: Any) -> Callable[[Column, Column], Column]:
    """A column function (response, truth) -> (reward, passed, extra) of a file's function."""

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = fn.load()
        for responses, truths in batches:
            yield pd.DataFrame([resolved(own(r, t, **options)) for r, t in zip(responses, truths, strict=True)], columns=_RESULT.names)

    return run


def _scored(df: DataFrame, score: Callable[[Any, list[tuple]], list[tuple]], start: Callable[[], Any]) -> DataFrame:
    """Adds reward, passed and extra. Only source, response and truth go to the workers, an Arrow batch at a time; ``start``
    runs once per task."""

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = start()
        for columns in batches:
            yield _as_struct(score(own, list(zip(*(c.to_pylist() for c in columns), strict=True))))

    return df.withColumn("__scored", run("source", "response", "truth")).select(*df.columns, "__scored.*")


def _as_struct(scored: list[tuple[float, bool, dict[str, str]]]) -> pa.Array:
    """Rows of ``_RESULT``."""
    rewards, passed, extras = (list(x) for x in zip(*scored, strict=True)) if scored else ([], [], [])
    ends = [0]
    for e in extras:
        ends.append(ends[-1] + len(e))
    keys, values = pa.array([k for e in extras for k in e], pa.string()), pa.array([v for e in extras for v in e.values()], pa.string())
    parts = [pa.array(rewards, pa.float64()), pa.array(passed, pa.bool_()), pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, values)]
    return pa.StructArray.from_arrays(parts, names=_RESULT.names)


@manager("batch")
def batch(df: DataFrame, fn: Scorer, **options: Any) -> DataFrame:
    """``fn(sources, responses, truths, **options)`` scores all rows of an Arrow batch at once, so it must not depend on which
    rows are together; another number of scores than rows is an error."""

    def score(own: Callable, rows: list[tuple]) -> list[tuple]:
        got = list(own(*(list(x) for x in zip(*rows, strict=True)), **options)) if rows else []
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} scores for {len(rows)} rows")
        return [resolved(x) for x in got]

    return _finished(_scored(df, score, lambda: _callable(fn)))


@manager("prime")
def prime(df: DataFrame, fn: Scorer, timeout: float = 300.0, together: int = 64) -> DataFrame:
    """``fn(source, response, truth)`` scores rows one by one, ``together`` at a time; a coroutine function is awaited, others run
    in threads. What fails, takes longer than ``timeout`` seconds or gives nothing scores 0; of a list, the first counts. A thread that
    never ends can't be stopped and holds its place until its task's process ends."""

    def value_of(got: Any) -> float:
        if isinstance(got, dict):
            got = got["score"]
        elif isinstance(got, (list, tuple)):
            got = got[0]
        value = float(got)
        return value if math.isfinite(value) else 0.0

    async def one(own: Callable, gate: asyncio.Semaphore, row: tuple) -> float:
        async with gate:
            try:
                return value_of(await asyncio.wait_for(own(*row), timeout))
            except Exception:  # the rule: a scorer's failure is a score of 0
                return 0.0

    async def all_of(own: Callable, rows: list[tuple]) -> list[float]:
        gate = asyncio.Semaphore(together)
        return await asyncio.gather(*(one(own, gate, r) for r in rows))

    def score(own: Callable, rows: list[tuple]) -> list[tuple]:
        got = asyncio.run(all_of(own, rows)) if inspect.iscoroutinefunction(own) else _in_threads(lambda row: value_of(own(*row)), rows, timeout, together)
        return [(s, s > 0, {"acc": str(s)}) for s in got]

    return _finished(_scored(df, score, lambda: _callable(fn)))


def _in_threads(call: Callable[[tuple], float], rows: list[tuple], timeout: float, together: int) -> list[float]:
    """The value of each row, 0 where the call fails or takes longer. Threads take row after row, so that a row costs little
    beside its call. Where late calls hold all places for another ``timeout``, the rows that are left score 0."""
    out, began, lock, at, closed = [0.0] * len(rows), {}, threading.Lock(), 0, False

    def work(me: int) -> None:
        nonlocal at
        while True:
            with lock:
                i = at
                if closed or i >= len(rows):
                    began.pop(me, None)
                    return
                at = i + 1
            began[me] = start = time.monotonic()
            try:
                value = call(rows[i])
            except Exception:  # the rule: a scorer's failure is a score of 0
                continue
            if time.monotonic() - start <= timeout:
                out[i] = value

    pool, open_, held = ThreadPoolExecutor(together), set(), None
    try:
        for me in range(min(together, len(rows))):
            if at >= len(rows):
                break
            open_.add(pool.submit(work, me))
        while open_:
            done, open_ = wait(open_, min(0.05, timeout), FIRST_COMPLETED)
            for f in done:
                f.result()
            with lock:
                now, running = time.monotonic(), [*began.values()]
                if len(running) < len(open_) or any(now - t <= timeout for t in running):
                    held = None
                    continue
                held = held or now
                if at >= len(rows) or now - held > timeout:
                    closed = True
                    break
        return out[:]
    finally:
        closed = True
        pool.shutdown(wait=False, cancel_futures=True)
