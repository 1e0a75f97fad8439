"""Spectra of updates: effective rank, summaries, scores over layers and families, subspace overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = {"q_proj": "Q", "k_proj": "K", "v_proj": "V", "o_proj": "O", "gate_proj": "GATE", "up_proj": "UP", "down_proj": "DOWN"}
SCOPES = {"qkvo": ("Q", "K", "V", "O"), "mlp": ("GATE", "UP", "DOWN"), "all": ("Q", "K", "V", "O", "GATE", "UP", "DOWN")}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def effective_rank(s: Column) -> Column:
    """exp of the entropy of s / sum(s); 0 for a zero spectrum, an error for a negative or infinite value."""
    total = _sum(s)
    entropy = -_sum(F.transform(F.filter(s, lambda x: x > 0), lambda x: x / total * F.log(x / total)))
    bad = F.exists(s, lambda x: (x < 0) | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("a spectrum holds a negative or infinite value")).cast("double")).when(total > 0, F.exp(entropy)).otherwise(0.0)


def summary(s: Column, frobenius: Column) -> dict[str, Column]:
    """Of the largest singular values ``s``, in descending order, of a matrix with that Frobenius norm."""
    energy, all_energy, first = _sum(F.transform(s, lambda x: x * x)), frobenius * frobenius, s[0]
    return {
        "total": _sum(s),
        "spectral_norm": first,
        "frobenius_norm": frobenius,
        "stable_rank": F.when(first > 0, all_energy / (first * first)).otherwise(0.0),
        "energy_ratio": F.when(all_energy > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), energy / all_energy))).otherwise(0.0),
    }


#: Where a transformer's layers and its weights stand in a parameter's name.
_LAYER, _ATTENTION, _MLP = r"(?:^|\.)(?:layers|h|blocks|block)\.(\d+)\.", r".*?self_attn\.(q_proj|k_proj|v_proj|o_proj)\.weight$", r".*?mlp\.(gate_proj|up_proj|down_proj)\.weight$"


def classify(name: Column, shape: Column | None = None, scope: str = "all") -> dict[str, Column]:
    """Layer and family of a weight by its parameter's name; null for others, for those outside ``scope`` (qkvo or all), and for
    shapes that aren't a matrix's, where a ``shape`` is given."""
    if scope not in ("qkvo", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    patterns = [_LAYER + _ATTENTION] + [_LAYER + _MLP] * (scope == "all")
    got = lambda i: F.coalesce(*(F.nullif(F.regexp_extract(name, p, i), F.lit("")) for p in patterns))
    matrix = F.lit(True) if shape is None else F.coalesce(F.size(shape) == 2, F.lit(False))
    family = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))[got(2)]
    return {"layer": F.when(matrix, got(1).cast("int")), "family": F.when(matrix, family)}


def scope_scores(matrices: DataFrame, value: str = "total", id: str = "id") -> DataFrame:
    """(id, a column per scope): ``value`` summed over layers and then families."""
    by_family = matrices.groupBy(id, "family").agg(F.sum(value).alias("s"))
    return by_family.groupBy(id).agg(*(F.sum(F.when(F.col("family").isin(*fs), F.col("s")).otherwise(0.0)).alias(scope) for scope, fs in SCOPES.items()))


def coverage_errors(matrices: DataFrame, id: str = "id") -> DataFrame:
    """(id, family, error) where a matrix comes twice or a family lacks a layer that others of its id have."""
    n = matrices.groupBy(id, "family").agg(F.count("*").alias("rows"), F.countDistinct("layer").alias("layers"))
    most = n.groupBy(id).agg(F.max("layers").alias("most"))
    found = n.join(most, id).withColumn("error", F.when(F.col("rows") > F.col("layers"), "duplicate matrix").when(F.col("layers") < F.col("most"), "missing layer"))
    return found.where("error is not null").select(id, "family", "error")


def subspace_scores(matrices: DataFrame, side: str = "mean", id: str = "id") -> DataFrame:
    """(id, a column per scope): mean overlap over the scope's matrices; ``side`` is u, v or mean."""
    phi = {"u": F.col("phi_u"), "v": F.col("phi_v"), "mean": (F.col("phi_u") + F.col("phi_v")) / 2}[side]
    return matrices.groupBy(id).agg(*(F.avg(F.when(F.col("family").isin(*fs), phi)).alias(scope) for scope, fs in SCOPES.items()))


def eligibility(zero_advantage: Column, zero_delta: Column, target: str = "marginal") -> Column:
    """Why a group can't be chosen; null if it can."""
    return F.when(zero_advantage, "zero_advantage").when(F.lit(target == "marginal") & zero_delta, "zero_marginal_delta")


def record_errors(s: Column, k: Column, total: Column, rank: Column, spectral: Column, frobenius: Column) -> Column:
    """The faults of a spectral record, as an array of messages."""
    checks = [
        (F.size(s) != k, "the number of singular values is not the rank"),
        (F.exists(s, lambda x: (x < 0) | F.isnan(x)), "a singular value is negative or not a number"),
        (F.exists(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a < b), lambda x: x), "the singular values are not in descending order"),
        (F.abs(_sum(s) - total) > 1e-6 * F.greatest(F.lit(1.0), total), "the sum is not that of the singular values"),
        ((rank < 0) | (rank > F.size(s) + 1e-9), "the effective rank is out of its range"),
        (F.abs(s[0] - spectral) > 1e-6 * F.greatest(F.lit(1.0), spectral), "the spectral norm is not the first singular value"),
        (frobenius * (1 + 1e-6) < spectral, "the Frobenius norm is under the spectral norm"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)))


MATRIX = "array<array<double>>"


def svd_factors(m: np.ndarray, rank: int, oversample: int = 8, rounds: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left vectors, singular values and right vectors (as columns) by a seeded range finder, largest first."""
    q = min(rank + oversample, *m.shape)
    if q == min(m.shape):
        u, s, v = np.linalg.svd(m, full_matrices=False)
    else:
        y = m @ np.random.default_rng(seed).standard_normal((m.shape[1], q))
        for _ in range(rounds):
            y = m @ (m.T @ np.linalg.qr(y)[0])
        base = np.linalg.qr(y)[0]
        w, s, v = np.linalg.svd(base.T @ m, full_matrices=False)
        u = base @ w
    k = min(rank, *m.shape)
    return u[:, :k], s[:k], v[:k].T


def truncated_svd(matrices: DataFrame, rank: int, oversample: int = 8, rounds: int = 2, seed: int = 0, id: str = "id", matrix: str = "matrix") -> DataFrame:
    """(id, s, frobenius) of one matrix per row; a zero matrix has zeros."""

    @F.pandas_udf("s array<double>, frobenius double")
    def run(col: pd.Series) -> pd.DataFrame:
        got = [np.stack(x) for x in col]
        return pd.DataFrame({"s": [svd_factors(m, rank, oversample, rounds, seed)[1].tolist() for m in got], "frobenius": [float(np.linalg.norm(m)) for m in got]})

    return matrices.select(id, run(matrix).alias("r")).select(id, "r.*")


def subspace_overlap(matrices: DataFrame, reference: DataFrame, rank: int, key: str, id: str = "id", matrix: str = "matrix") -> DataFrame:
    """(id, key, phi_u, phi_v): squared overlap of each matrix's leading vectors with those of the reference
    matrix of the same ``key``, over the rank; 0 for a zero matrix."""

    @F.pandas_udf("phi_u double, phi_v double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            m, r = np.stack(x), np.stack(y)
            if not m.any():
                out.append((0.0, 0.0))
                continue
            (u, _, v), (p, _, q) = svd_factors(m, rank), svd_factors(r, rank)
            k = min(u.shape[1], p.shape[1])
            out.append(tuple(min(1.0, float(np.square(x[:, :k].T @ y[:, :k]).sum()) / k) for x, y in ((u, p), (v, q))))
        return pd.DataFrame(out, columns=["phi_u", "phi_v"])

    both = matrices.join(reference.select(key, F.col(matrix).alias("__ref")), key)
    return both.select(id, key, run(matrix, "__ref").alias("r")).select(id, key, "r.*")
