"""Asynchronous sample streams: a bounded queue, staleness, batches, windows; each also over a static table.

A stream of samples has a key (the queue), an id in order of arrival and the parameter version that made it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def kept_in_queue(df: DataFrame, size: int, key: str, order: str) -> DataFrame:
    """Adds kept: the last ``size`` of a queue that drops its oldest and that nobody empties."""
    at = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("kept", at <= size)


def queue_totals(df: DataFrame, size: int, key: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(key).agg(n.alias("produced"), F.least(n, F.lit(size)).cast("long").alias("held"), F.greatest(n - size, F.lit(0)).cast("long").alias("dropped"))


def staleness(df: DataFrame, current: Column, made: Column, threshold: int = 1) -> DataFrame:
    """Adds lag and stale; a stale sample stays and is counted."""
    lag = current - made
    return df.withColumns({"lag": lag, "stale": lag >= threshold})


def staleness_totals(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("samples"), F.count_if("stale").alias("stale"), F.max("lag").alias("largest_lag"))


def assembled(df: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """Adds batch: full batches of ``n`` in the order of arrival; the rest waits (null)."""
    w = W.partitionBy(key)
    at, total = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    batch = F.floor((at - 1) / n)
    return df.withColumn("batch", F.when(batch < F.floor(total / n), batch))


def should_pause(queued: Column, in_flight: Column, size: int, required: int, threshold: int, sync_steps: int) -> Column:
    """Back-pressure: the queue is full, or more is on its way than the staleness bound lets be used."""
    return (queued >= size) | (in_flight >= required * (threshold + 1) * sync_steps)


def version_of(order: Column, every: int) -> Column:
    return F.floor(order / every)


class QueueState(StatefulProcessor):
    """Counts of produced and dropped samples per queue, and the ids that it holds now."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "id long")
        self.totals = handle.getValueState("totals", "produced long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = [int(x[0]) for x in self.held.get()] if self.held.exists() else []
        produced, dropped = self.totals.get() if self.totals.exists() else (0, 0)
        new = sorted(int(i) for part in rows for i in part["id"])
        ids += new
        dropped += max(0, len(ids) - self.size)
        ids = ids[-self.size :]
        self.held.put([(i,) for i in ids])
        self.totals.update((produced + len(new), dropped))
        yield pd.DataFrame({"queue": [key[0]], "produced": [produced + len(new)], "dropped": [dropped], "held": [len(ids)]})

    def close(self) -> None:
        pass


def bounded_queue(stream: DataFrame, size: int) -> DataFrame:
    """Streaming (queue, produced, dropped, held) of a stream of (queue, id)."""
    return stream.groupBy("queue").transformWithStateInPandas(QueueState(size), "queue string, produced long, dropped long, held long", "Update", "None")


class BatchState(StatefulProcessor):
    """Emits samples of a queue whenever ``n`` have come; fewer wait in the state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "id long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = [int(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        ids += sorted(int(i) for part in rows for i in part["id"])
        batch = self.count.get()[0] if self.count.exists() else 0
        full = len(ids) // self.n
        if full:
            yield pd.DataFrame({"queue": key[0], "batch": [batch + i // self.n for i in range(full * self.n)], "id": ids[: full * self.n]})
        if rest := ids[full * self.n :]:
            self.waiting.put([(i,) for i in rest])
        else:
            self.waiting.clear()
        self.count.update((batch + full,))

    def close(self) -> None:
        pass


def batches(stream: DataFrame, n: int) -> DataFrame:
    """Streaming (queue, batch, id)."""
    return stream.groupBy("queue").transformWithStateInPandas(BatchState(n), "queue string, batch long, id long", "Append", "None")


def windowed(stream: DataFrame, time: str, value: str, late: str = "10 minutes", size: str = "5 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """An extension: sums over event-time windows, late rows counted until the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def incremental(stream: DataFrame, checkpoint: str, score, out: str):
    """Selection round by round: ``score(batch)`` of each arriving chunk is appended to ``out``, a folder per round
    that a repeated round overwrites; a restart goes on after the last finished one."""

    def one(rows: DataFrame, round: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{out}/round={round}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
