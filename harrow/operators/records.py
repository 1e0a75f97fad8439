"""Validation of analysis records: one list of what must hold, evaluated in one pass.

A record is a group's matrices, scores and sampled responses, with what was derived from them stored beside it. The
derived values are recomputed from their parts. A field that is missing or null fails each check that reads it, unless
the check says that it may be absent. A fault doesn't hide others: every record gets all its faults, in the order below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.spectral import FAMILIES, SCOPES

# Field names, versions and words of the stored format.
STATISTICS = ("frobenius_norm", "spectral_norm", "stable_rank", "topk_energy_ratio", "topk_effective_rank")
COUNTS = ("response_tokens", "prompt_tokens", "generated_response_tokens", "input_tokens", "original_input_tokens")
LISTS = {
    "global_indices": "bigint",
    **dict.fromkeys(COUNTS, "bigint"),
    "analysis_truncated_flags": "boolean",
    "generation_hit_max_tokens_flags": "boolean",
    "generation_finish_reasons": "string",
    "generation_stop_reasons": "string",
    "requested_max_tokens": "bigint",
    "rewards": "double",
    "advantages": "double",
}
SCOPE_NAMES = {"qkvo_only": "qkvo", "ffn_only": "mlp", "transformer_2d": "all"}
TARGETS = ("actual_data", "marginal_data", "full")
VERSIONS = {"effective_rank": 5, "subspace": 6}
FILTERS = {"zero_advantage": "boolean", "marginal_delta_all_zero": "boolean", "selection_eligible": "boolean"}

#: The schema by which stored lines are read; absent fields become null.
MATRIX = f"struct<{', '.join(f'{k}: double' for k in STATISTICS)}, subspace_rank: bigint, subspace_phi_u: double, subspace_phi_v: double>"
GROUP_STATS = "struct<" + ", ".join(
    f"{k}: {t}"
    for k, t in {
        **{k: f"array<{t}>" for k, t in LISTS.items()},
        **dict.fromkeys(("group_id", "worker_rank", "total_response_tokens", "question_tokens", "analysis_truncated_responses", "generation_hit_max_tokens_responses", "advantage_std_correction"), "bigint"),
        **dict.fromkeys(("reward_mean", "reward_std", "advantage_epsilon", "svd_score", "subspace_phi_u", "subspace_phi_v", "subspace_score"), "double"),
        **dict.fromkeys(("analysis_method", "svd_score_scope", "svd_gradient_source", "adamw_update_target", "advantage_estimator", "token_input_source", "subspace_score_side", "selection_filter_reason"), "string"),
        **FILTERS,
        "norm_adv_by_std_in_grpo": "boolean",
    }.items()
) + ">"
RECORD = {
    "group_id": "bigint",
    "record_schema_version": "bigint",
    "worker_rank": "bigint",
    **dict.fromkeys(("analysis_method", "gradient_parameter_scope", "svd_gradient_source", "adamw_update_target", "svd_score_scope", "selection_filter_reason"), "string"),
    **FILTERS,
    "matrices": f"map<string, {MATRIX}>",
    "effective_rank_topk": "struct<score_scope: string, s: double, per_family_layer_sum: map<string, double>, scores_by_scope: map<string, double>>",
    "subspace_similarity": "struct<score_side: string, phi_u: double, phi_v: double, s: double>",
    "group_stats": GROUP_STATS,
}
SCHEMA = ", ".join(f"{k} {t}" for k, t in RECORD.items())


def close(a: Column, b: Column, rel: float, least: float = 0.0) -> Column:
    """Both finite and within ``rel`` of the larger, or within ``least``."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return finite(a) & finite(b) & (F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(least)))


def _unit(x: Column) -> Column:
    return (x >= 0) & (x <= 1)


def _total(values: Column, of=lambda x: x.cast("double")) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def moments(records: DataFrame) -> DataFrame:
    """Adds the rewards' mean and deviation, as of a lone reward 0 and 1, each computed once for all checks."""
    rewards, mean = F.col("group_stats.rewards"), F.col("__mean")
    n = F.size(rewards)
    own = records.withColumn("__mean", F.when(n == 1, 0.0).otherwise(F.try_divide(_total(rewards), n)))
    return own.withColumn("__std", F.when(n == 1, 1.0).otherwise(F.sqrt(F.try_divide(_total(rewards, lambda x: (x - mean) * (x - mean)), n - 1))))


def checks(rollouts: int | Column, worker: int | Column) -> list[tuple[str, Column]]:
    """(fault, what must hold) of a record in the columns of ``SCHEMA`` and ``moments``."""
    rollouts, worker = (F.lit(x) if isinstance(x, int) else x for x in (rollouts, worker))
    c, true = F.col, F.lit(True)
    stats, spectrum, overlap = c("group_stats"), c("effective_rank_topk"), c("subspace_similarity")
    method = F.coalesce(c("analysis_method"), F.lit("effective_rank"))
    source, target, scope = F.coalesce(c("svd_gradient_source"), F.lit("raw")), c("adamw_update_target"), c("svd_score_scope")
    sub = method == "subspace"
    only_sub = lambda holds: ~sub | F.coalesce(holds, F.lit(False))
    matrices = F.map_values("matrices")
    each = lambda holds: F.forall(matrices, lambda m: F.coalesce(holds(m), F.lit(False)))
    sums, by_scope = spectrum["per_family_layer_sum"], spectrum["scores_by_scope"]
    scored = {name: reduce(lambda a, b: a + b, (sums[f] for f in SCOPES[s])) for name, s in SCOPE_NAMES.items()}
    chosen = reduce(lambda rest, name: F.when(scope == name, scored[name]).otherwise(rest), scored, F.lit(None).cast("double"))
    out: list[tuple[str, Column]] = [
        ("record_schema_version is not that of the method", reduce(lambda rest, m: F.when(method == m, c("record_schema_version") == VERSIONS[m]).otherwise(rest), VERSIONS, F.lit(False))),
        ("worker_rank is not that of the worker", c("worker_rank") == worker),
        ("no matrices", F.size("matrices") > 0),
        ("analysis_method is unknown", method.isin(*VERSIONS)),
    ]
    out += [(f"a matrix has an invalid {k}", each(lambda m, k=k: (m[k] >= 0) & (m[k] < float("inf")) & ~F.isnan(m[k]))) for k in STATISTICS]
    out += [
        ("a matrix has an energy ratio over 1", each(lambda m: m["topk_energy_ratio"] <= 1)),
        ("a matrix has no positive subspace_rank", only_sub(each(lambda m: m["subspace_rank"] > 0))),
        ("a matrix has subspace_phi_u outside 0 to 1", only_sub(each(lambda m: _unit(m["subspace_phi_u"])))),
        ("a matrix has subspace_phi_v outside 0 to 1", only_sub(each(lambda m: _unit(m["subspace_phi_v"])))),
        ("gradient_parameter_scope is not transformer_2d", c("gradient_parameter_scope") == "transformer_2d"),
        ("svd_gradient_source is unknown", source.isin("raw", "adamw")),
        ("adamw_update_target is unknown", (source != "adamw") | F.coalesce(target.isin(*TARGETS), F.lit(False))),
        ("adamw_update_target beside raw gradients", (source != "raw") | target.isNull()),
        ("subspace analysis of other than adamw gradients", ~sub | (source == "adamw")),
        ("svd_score_scope is unknown", scope.isin(*SCOPE_NAMES)),
        ("no effective_rank_topk", spectrum.isNotNull()),
        ("effective_rank_topk.score_scope differs", spectrum["score_scope"] == scope),
        ("no per_family_layer_sum", sums.isNotNull()),
        ("per_family_layer_sum has not the seven families", F.array_sort(F.map_keys(sums)) == F.array(*(F.lit(f) for f in sorted(FAMILIES.values())))),
        ("no scores_by_scope", by_scope.isNotNull()),
    ]
    out += [(f"scores_by_scope.{name} is not the sum of its families", close(by_scope[name], s, 1e-12, 1e-12)) for name, s in scored.items()]
    out += [
        ("effective_rank_topk.s is not the score of its scope", close(spectrum["s"], chosen, 1e-12, 1e-12)),
        ("no group_stats", stats.isNotNull()),
        ("group_stats.svd_score_scope differs", stats["svd_score_scope"] == scope),
        ("group_stats.svd_gradient_source differs", F.coalesce(stats["svd_gradient_source"], F.lit("raw")) == source),
        ("group_stats.adamw_update_target differs", stats["adamw_update_target"].eqNullSafe(target)),
        ("group_stats.analysis_method differs", F.coalesce(stats["analysis_method"], F.lit("effective_rank")) == method),
    ]
    for k in FILTERS:
        out += [(f"no {k}", only_sub(c(k).isNotNull())), (f"group_stats.{k} differs", only_sub(stats[k] == c(k)))]
    no_change = F.coalesce(target == "marginal_data", F.lit(False)) & each(lambda m: m["frobenius_norm"] == 0)
    reason = F.when(c("zero_advantage"), "zero_advantage").when(no_change, "zero_marginal_delta")
    out += [
        ("marginal_delta_all_zero is not that of the matrices", only_sub(c("marginal_delta_all_zero") == no_change)),
        ("selection_filter_reason is not that of the flags", only_sub(c("selection_filter_reason").eqNullSafe(reason))),
        ("group_stats.selection_filter_reason differs", only_sub(stats["selection_filter_reason"].eqNullSafe(c("selection_filter_reason")))),
        ("selection_eligible is not that of the reason", only_sub(c("selection_eligible") == reason.isNull())),
    ]
    out += [(f"group_stats.{k} has not one value per response", F.size(stats[k]) == rollouts) for k in LISTS]
    advantages, mean, std = stats["advantages"], c("__mean"), c("__std")
    expected = F.zip_with(stats["rewards"], advantages, lambda r, a: F.coalesce(close(a, F.try_divide(r - stats["reward_mean"], stats["reward_std"] + 1e-6), 1e-6, 1e-6), F.lit(False)))
    total = F.coalesce(stats["total_response_tokens"], stats["question_tokens"])
    tokens = F.arrays_zip(*(stats[k].alias(k) for k in COUNTS))
    every = lambda holds: F.forall(tokens, lambda t: F.coalesce(holds(t), F.lit(False)))
    set_flags = lambda k: F.size(F.filter(stats[k], lambda x: x))
    out += [
        ("question_tokens and total_response_tokens differ", F.coalesce(stats["question_tokens"] == total, true)),
        ("total_response_tokens is not the sum of response_tokens", total == _total(stats["response_tokens"])),
        ("advantage_estimator is not grpo", stats["advantage_estimator"] == "grpo"),
        ("advantages are not divided by the deviation", stats["norm_adv_by_std_in_grpo"]),
        ("advantage_epsilon is not 1e-6", F.abs(stats["advantage_epsilon"] - 1e-6) <= 1e-12),
        ("advantage_std_correction is not 1", stats["advantage_std_correction"] == 1),
        ("reward_mean is not that of the rewards", close(stats["reward_mean"], mean, 1e-6, 1e-6)),
        ("reward_std is not that of the rewards", close(stats["reward_std"], std, 1e-6, 1e-6)),
        ("an advantage is not that of its reward", F.forall(expected, lambda x: x)),
        ("zero_advantage is not that of the advantages", only_sub(c("zero_advantage") == F.forall(advantages, lambda a: F.abs(a) < 1e-6))),
        ("a response's tokens are not prompt and generated tokens", every(lambda t: t["original_input_tokens"] == F.try_add(t["prompt_tokens"], t["generated_response_tokens"]))),
        ("a response has more input than original tokens", every(lambda t: t["input_tokens"] <= t["original_input_tokens"])),
        ("a response has more kept than generated tokens", every(lambda t: t["response_tokens"] <= t["generated_response_tokens"])),
        ("analysis_truncated_responses is not the number of flags", stats["analysis_truncated_responses"] == set_flags("analysis_truncated_flags")),
        ("generation_hit_max_tokens_responses is not the number of flags", stats["generation_hit_max_tokens_responses"] == set_flags("generation_hit_max_tokens_flags")),
        ("token_input_source is not inference_token_ids", stats["token_input_source"] == "inference_token_ids"),
        ("group_stats.group_id differs", stats["group_id"] == c("group_id")),
        ("group_stats.worker_rank differs", stats["worker_rank"] == worker),
        ("group_stats.svd_score is not effective_rank_topk.s", close(stats["svd_score"], spectrum["s"], 1e-12)),
        ("subspace_similarity beside another method", sub | overlap.isNull()),
        ("no subspace_similarity", only_sub(overlap.isNotNull())),
    ]
    side, u, v = overlap["score_side"], overlap["phi_u"], overlap["phi_v"]
    score = F.when(side == "u", u).when(side == "v", v).when(side == "mean", (u + v) / 2)
    out += [
        ("score_side is unknown", only_sub(side.isin("u", "v", "mean"))),
        ("phi_u outside 0 to 1", only_sub(_unit(u))),
        ("phi_v outside 0 to 1", only_sub(_unit(v))),
        ("subspace_similarity.s is not that of its side", only_sub(close(overlap["s"], score, 1e-12, 1e-12))),
        ("group_stats.subspace_score_side differs", only_sub(stats["subspace_score_side"] == side)),
    ]
    out += [(f"group_stats.{k} differs", only_sub(close(stats[k], x, 1e-12, 1e-12))) for k, x in (("subspace_phi_u", u), ("subspace_phi_v", v), ("subspace_score", overlap["s"]))]
    return out


def faults(records: DataFrame, rollouts: int | Column, worker: int | Column) -> DataFrame:
    """Adds faults, an array of messages; empty for a good record. A narrow pass: nothing is shuffled."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)) for text, holds in checks(rollouts, worker))))
    return moments(records).withColumn("faults", found).drop("__mean", "__std")


def fault_counts(records: DataFrame, rollouts: int | Column, worker: int | Column) -> DataFrame:
    """(fault, records), of the faults that occur."""
    return faults(records, rollouts, worker).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("records"))


def require_valid(records: DataFrame, rollouts: int | Column, worker: int | Column) -> DataFrame:
    """The records; one with faults is an error that names its group, when its row is read."""
    names = records.columns
    bad = F.concat(F.lit("group_id="), F.coalesce(F.col("group_id").cast("string"), F.lit("null")), F.lit(": "), F.array_join("faults", "; "))
    return faults(records, rollouts, worker).where(F.when(F.size("faults") == 0, F.lit(True)).otherwise(F.raise_error(bad).cast("boolean"))).select(*names)
