"""The law of a majority vote among values drawn with replacement, exactly.

The counts of k draws are independent Poisson numbers, given that their sum is k. A vote wins with m draws if the others have at
most m, and of votes that tie, each is as likely as the others to have been drawn first. So with a polynomial in x for each other
vote, whose coefficients are its Poisson terms below m plus y times the term at m, the chance is a coefficient of the product,
averaged over y from 0 to 1: the integral of y^t is 1 / (t + 1), the share of a vote that ties with t others. A few Gauss points
make the average exact, and products from both sides leave each vote out in turn.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=65536)
def win_chances(counts: tuple[int, ...], k: int) -> tuple[float, ...]:
    """For votes held by so many of the values: the chance that each is the majority of k draws."""
    n = sum(counts)
    rate = np.array(counts) * k / n
    j = np.arange(k + 1)
    log_fact = np.array([math.lgamma(i + 1) for i in range(k + 1)])
    term = np.exp(j * np.log(rate)[:, None] - rate[:, None] - log_fact)
    whole = math.exp(k * math.log(k) - k - log_fact[k])
    chance = np.zeros(len(counts))
    for m in range(1, k + 1):
        rest = k - m
        ys, ws = np.polynomial.legendre.leggauss(max(1, (min(k // m, len(counts)) + 1) // 2))
        for y, w in zip((ys + 1) / 2, ws / 2, strict=True):
            parts = [np.append(t[:m], y * t[m])[: rest + 1] for t in term]
            left, right = [np.ones(1)], [np.ones(1)]
            for p in parts[:-1]:
                left.append(np.convolve(left[-1], p)[: rest + 1])
            for p in parts[:0:-1]:
                right.append(np.convolve(right[-1], p)[: rest + 1])
            for c, (x, z) in enumerate(zip(left, reversed(right), strict=True)):
                lo, hi = max(0, rest - len(z) + 1), min(rest, len(x) - 1)
                if lo <= hi:
                    chance[c] += w * term[c, m] * float(x[lo : hi + 1] @ z[rest - hi : rest - lo + 1][::-1])
    return tuple((chance / whole).tolist())


def sizes(n: int) -> list[int]:
    """2, 4, 8, ... under n, and n, for n over 1."""
    return [*(1 << i for i in range(1, n.bit_length()) if 1 << i < n), n] if n > 1 else []


def majority(df: DataFrame, ks: list[int] | None = None, group: str = "group_id", vote: str = "pred", value: str = "reward") -> DataFrame:
    """(group, k, majority, majority_std): mean and deviation of the value of the first drawn of the majority's rows, over k draws
    with replacement. k runs over 2, 4, 8, ..., n, or over ``ks``. A null vote is a vote as any other."""
    x = F.col(value).cast("double")
    votes = df.groupBy(group, vote).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg(x * x).alias("square"))
    rows = votes.groupBy(group).agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("n", "mean", "square"))).alias("v"))
    if ks is None:
        rows = rows.where(F.col("all") > 1)  # one value has no sizes

    @F.arrow_udf("array<struct<k:bigint,mean:double,std:double>>")
    def law(n: pa.Array, mean: pa.Array, square: pa.Array) -> pa.Array:
        got, ends = ([], [], []), [0]
        for c, a, b in zip(n.to_pylist(), mean.to_pylist(), square.to_pylist(), strict=True):
            counts = tuple(c)
            a, b = ([math.nan if x is None else x for x in y] for y in (a, b))
            for k in sizes(sum(counts)) if ks is None else ks:
                p = win_chances(counts, k)
                m = math.sumprod(p, a)
                for x, y in zip(got, (k, m, math.sqrt(max(0.0, math.sumprod(p, b) - m * m))), strict=True):
                    x.append(y)
            ends.append(len(got[0]))
        parts = [pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.float64(), pa.float64()), strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["k", "mean", "std"]))

    laws = rows.select(group, F.explode(law("v.n", "v.mean", "v.square")).alias("l"))
    return laws.select(group, F.col("l.k").alias("k"), F.col("l.mean").alias("majority"), F.col("l.std").alias("majority_std"))
