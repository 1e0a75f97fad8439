"""Packing groups into shards of equal cost.

The greedy and differencing methods are sequential by definition. They run once over (group, cost) rows
of one batch, whose number the batch size bounds, inside ``applyInPandas`` keyed by the batch, so batches
are packed in parallel and nothing is sent to the driver.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def greedy(costs: list[int], k: int, order: list[int], by: list[int] | None = None) -> list[int]:
    """Each item of ``order`` to the least loaded bin, the lowest on a tie."""
    heap, out = [(0, b) for b in range(k)], [0] * len(costs)
    for i in order:
        load, b = heapq.heappop(heap)
        out[i] = b
        heapq.heappush(heap, (load + costs[i], b))
    return out


def differencing(costs: list[int], k: int, equal: bool) -> list[int]:
    """Largest differencing: partial partitions, each a list of k (load, items) from heavy to light, are merged
    two by two, the most uneven first, heavy parts with light ones."""
    first = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    step = k if equal else 1
    if equal and len(costs) % k:
        raise ValueError(f"{len(costs)} items don't divide into {k} equal parts")
    heap, serial = [], 0
    for at in range(0, len(first), step):
        parts = sorted(([costs[i], [i]] for i in first[at : at + step]), key=lambda p: (-p[0], p[1]))
        parts += [[0, []] for _ in range(k - len(parts))]
        heap.append((parts[-1][0] - parts[0][0], serial, parts))
        serial += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], serial, parts))
        serial += 1
    out = [0] * len(costs)
    if heap:
        for b, part in enumerate(sorted((sorted(p[1]) for p in heap[0][2]))):
            for i in part:
                out[i] = b
    return out


def pack(df: DataFrame, k: int, batch: str, id: str, cost: str, method: str = "lpt") -> DataFrame:
    """(batch, id, cost, shard): "lpt" takes the costliest first, "given" the rows by id, "given_equal" so with as
    many rows in each (their number must divide), "count" loads bins by rows,
    "kk" and "kk_equal" difference."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id, kind="stable").reset_index(drop=True)
        costs = rows[cost].tolist()
        heavy = sorted(range(len(costs)), key=lambda i: -costs[i])
        if method.startswith("kk"):
            shard = differencing(costs, k, method == "kk_equal")
        elif method == "given_equal":
            if len(costs) % k:
                raise ValueError(f"{len(costs)} rows don't divide into {k} equal shards")
            bias = sum(costs) + 1  # more than all costs, so that numbers of rows come first
            shard = greedy([c + bias for c in costs], k, range(len(costs)))
        else:
            shard = greedy([1] * len(costs) if method == "count" else costs, k, range(len(costs)) if method == "given" else heavy)
        return rows.assign(shard=shard)[[batch, id, cost, "shard"]]

    kinds = dict(df.dtypes)
    return df.select(batch, id, cost).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {id} {kinds[id]}, {cost} {kinds[cost]}, shard long")


def micro_batches(df: DataFrame, budget: int, batch: str, id: str, cost: str) -> DataFrame:
    """(batch, id, cost, shard): as few differenced parts as the token budget allows, costliest first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id, kind="stable").reset_index(drop=True)
        costs = rows[cost].tolist()
        k = min(len(costs), -(-sum(costs) // budget)) or 1
        shard = differencing(costs, k, False)
        work = sorted(range(k), key=lambda b: -sum(c * c for c, s in zip(costs, shard, strict=True) if s == b))
        place = {b: i for i, b in enumerate(work)}
        return rows.assign(shard=[place[s] for s in shard])[[batch, id, cost, "shard"]]

    kinds = dict(df.dtypes)
    return df.select(batch, id, cost).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {id} {kinds[id]}, {cost} {kinds[cost]}, shard long")


def imbalance(df: DataFrame, shard: str, cost: str, by: list[str]) -> DataFrame:
    """Least, largest and mean load of the shards."""
    loads = df.groupBy(*by, shard).agg(F.sum(cost).alias("load"))
    return loads.groupBy(*by).agg(F.min("load").alias("least"), F.max("load").alias("most"), F.avg("load").alias("mean"))


def round_robin(df: DataFrame, k: int, order: list[Column | str], batch: str) -> DataFrame:
    at = F.row_number().over(W.partitionBy(batch).orderBy(*order)) - 1
    return df.withColumn("shard", (at % k).cast("long"))


def machine_part(index: Column, part: int, size: int) -> Column:
    """Rows of machine ``part`` when each takes ``size`` consecutive ones."""
    return (index >= part * size) & (index < (part + 1) * size)


def inverse_order(df: DataFrame, shard: str, id: str, batch: str) -> DataFrame:
    """Adds place (from 0, shard by shard, by id within) and origin, the place of a row by id: what puts the
    shards' joined results back in order."""
    over = W.partitionBy(batch)
    return df.withColumns({"place": (F.row_number().over(over.orderBy(shard, id)) - 1).cast("long"), "origin": (F.row_number().over(over.orderBy(id)) - 1).cast("long")})


def rounded_count(n: Column, multiple: int, most: Column) -> Column:
    """The number of micro-batches up to a multiple of the stages that share them, at most ``most``."""
    return F.least(F.ceil(n / multiple) * multiple, most).cast("long")
