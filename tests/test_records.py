"""A good record of each method, and one broken copy per check."""

import copy
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harrow.operators import records as R

N = 2


def good(method="effective_rank"):
    sub = method == "subspace"
    target = "marginal_data" if sub else None
    sums = dict(zip("Q K V O GATE UP DOWN".split(), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], strict=True))
    scores = {"qkvo_only": 10.0, "ffn_only": 18.0, "transformer_2d": 28.0}
    std = 0.5**0.5
    advantage = 0.5 / (std + 1e-6)
    flags = {"zero_advantage": False, "marginal_delta_all_zero": False, "selection_eligible": True} if sub else {}
    stats = {
        "group_id": 7, "worker_rank": 1, "svd_score_scope": "ffn_only", "svd_score": 18.0, "svd_gradient_source": "adamw" if sub else "raw", "adamw_update_target": target, "analysis_method": method,
        "global_indices": [0, 1], "response_tokens": [3, 4], "prompt_tokens": [5, 5], "generated_response_tokens": [3, 6], "input_tokens": [8, 9], "original_input_tokens": [8, 11],
        "analysis_truncated_flags": [False, True], "generation_hit_max_tokens_flags": [False, False], "generation_finish_reasons": ["stop", "length"], "generation_stop_reasons": ["", ""], "requested_max_tokens": [9, 9],
        "rewards": [0.0, 1.0], "advantages": [-advantage, advantage], "reward_mean": 0.5, "reward_std": std, "total_response_tokens": 7, "analysis_truncated_responses": 1, "generation_hit_max_tokens_responses": 0,
        "advantage_estimator": "grpo", "norm_adv_by_std_in_grpo": True, "advantage_epsilon": 1e-6, "advantage_std_correction": 1, "token_input_source": "inference_token_ids", **flags,
    }
    matrix = dict.fromkeys(R.STATISTICS, 0.5)
    row = {"group_id": 7, "record_schema_version": 6 if sub else 5, "worker_rank": 1, "analysis_method": method, "gradient_parameter_scope": "transformer_2d", "svd_gradient_source": stats["svd_gradient_source"], "adamw_update_target": target, "svd_score_scope": "ffn_only",
           "matrices": {"a": matrix}, "effective_rank_topk": {"score_scope": "ffn_only", "s": 18.0, "per_family_layer_sum": sums, "scores_by_scope": scores}, "group_stats": stats, **flags}
    if sub:
        matrix |= {"subspace_rank": 4, "subspace_phi_u": 0.25, "subspace_phi_v": 0.75}
        row["subspace_similarity"] = {"score_side": "mean", "phi_u": 0.25, "phi_v": 0.75, "s": 0.5}
        stats |= {"subspace_score_side": "mean", "subspace_phi_u": 0.25, "subspace_phi_v": 0.75, "subspace_score": 0.5}
    return row


def changed(path, value, method="effective_rank"):
    row = copy.deepcopy(good(method))
    *way, last = path.split(".")
    at = row
    for k in way:
        at = at[k]
    if value is KeyError:
        at.pop(last)
    else:
        at[last] = value
    return row


S, T = "subspace", "effective_rank"
#: message: (path, value, method)
BROKEN = {
    "record_schema_version is not that of the method": ("record_schema_version", 6, T),
    "worker_rank is not that of the worker": ("worker_rank", 2, T),
    "no matrices": ("matrices", {}, T),
    "analysis_method is unknown": ("analysis_method", "other", T),
    **{f"a matrix has an invalid {k}": (f"matrices.a.{k}", KeyError if i else -1.0, T) for i, k in enumerate(R.STATISTICS)},
    "a matrix has an energy ratio over 1": ("matrices.a.topk_energy_ratio", 1.5, T),
    "a matrix has no positive subspace_rank": ("matrices.a.subspace_rank", 0, S),
    "a matrix has subspace_phi_u outside 0 to 1": ("matrices.a.subspace_phi_u", 1.5, S),
    "a matrix has subspace_phi_v outside 0 to 1": ("matrices.a.subspace_phi_v", KeyError, S),
    "gradient_parameter_scope is not transformer_2d": ("gradient_parameter_scope", "all", T),
    "svd_gradient_source is unknown": ("svd_gradient_source", "sgd", T),
    "adamw_update_target is unknown": ("adamw_update_target", "some", S),
    "adamw_update_target beside raw gradients": ("adamw_update_target", "full", T),
    "subspace analysis of other than adamw gradients": ("svd_gradient_source", "raw", S),
    "svd_score_scope is unknown": ("svd_score_scope", "mlp", T),
    "no effective_rank_topk": ("effective_rank_topk", None, T),
    "effective_rank_topk.score_scope differs": ("effective_rank_topk.score_scope", "qkvo_only", T),
    "no per_family_layer_sum": ("effective_rank_topk.per_family_layer_sum", KeyError, T),
    "per_family_layer_sum has not the seven families": ("effective_rank_topk.per_family_layer_sum.X", 1.0, T),
    "no scores_by_scope": ("effective_rank_topk.scores_by_scope", None, T),
    "scores_by_scope.qkvo_only is not the sum of its families": ("effective_rank_topk.scores_by_scope.qkvo_only", 10.1, T),
    "scores_by_scope.ffn_only is not the sum of its families": ("effective_rank_topk.scores_by_scope.ffn_only", 18.0000001, T),
    "scores_by_scope.transformer_2d is not the sum of its families": ("effective_rank_topk.scores_by_scope.transformer_2d", KeyError, T),
    "effective_rank_topk.s is not the score of its scope": ("effective_rank_topk.s", 10.0, T),
    "no group_stats": ("group_stats", None, T),
    "group_stats.svd_score_scope differs": ("group_stats.svd_score_scope", "qkvo_only", T),
    "group_stats.svd_gradient_source differs": ("group_stats.svd_gradient_source", "adamw", T),
    "group_stats.adamw_update_target differs": ("group_stats.adamw_update_target", "full", T),
    "group_stats.analysis_method differs": ("group_stats.analysis_method", S, T),
    **{f"no {k}": (k, KeyError, S) for k in R.FILTERS},
    **{f"group_stats.{k} differs": (f"group_stats.{k}", KeyError, S) for k in R.FILTERS},
    "marginal_delta_all_zero is not that of the matrices": ("matrices.a.frobenius_norm", 0.0, S),
    "selection_filter_reason is not that of the flags": ("selection_filter_reason", "zero_advantage", S),
    "group_stats.selection_filter_reason differs": ("group_stats.selection_filter_reason", "zero_advantage", S),
    "selection_eligible is not that of the reason": ("selection_eligible", False, S),
    **{f"group_stats.{k} has not one value per response": (f"group_stats.{k}", [], T) for k in R.LISTS},
    "question_tokens and total_response_tokens differ": ("group_stats.question_tokens", 8, T),
    "total_response_tokens is not the sum of response_tokens": ("group_stats.total_response_tokens", 8, T),
    "advantage_estimator is not grpo": ("group_stats.advantage_estimator", "gae", T),
    "advantages are not divided by the deviation": ("group_stats.norm_adv_by_std_in_grpo", False, T),
    "advantage_epsilon is not 1e-6": ("group_stats.advantage_epsilon", 1e-5, T),
    "advantage_std_correction is not 1": ("group_stats.advantage_std_correction", 0, T),
    "reward_mean is not that of the rewards": ("group_stats.reward_mean", 0.6, T),
    "reward_std is not that of the rewards": ("group_stats.reward_std", 0.5, T),
    "an advantage is not that of its reward": ("group_stats.advantages", [-0.7, 0.8], T),
    "zero_advantage is not that of the advantages": ("zero_advantage", True, S),
    "a response's tokens are not prompt and generated tokens": ("group_stats.prompt_tokens", [5, 6], T),
    "a response has more input than original tokens": ("group_stats.input_tokens", [9, 9], T),
    "a response has more kept than generated tokens": ("group_stats.response_tokens", [4, 3], T),
    "analysis_truncated_responses is not the number of flags": ("group_stats.analysis_truncated_responses", 2, T),
    "generation_hit_max_tokens_responses is not the number of flags": ("group_stats.generation_hit_max_tokens_responses", KeyError, T),
    "token_input_source is not inference_token_ids": ("group_stats.token_input_source", "text", T),
    "group_stats.group_id differs": ("group_stats.group_id", 8, T),
    "group_stats.worker_rank differs": ("group_stats.worker_rank", 0, T),
    "group_stats.svd_score is not effective_rank_topk.s": ("group_stats.svd_score", 18.1, T),
    "subspace_similarity beside another method": ("subspace_similarity", {"s": 0.5}, T),
    "no subspace_similarity": ("subspace_similarity", KeyError, S),
    "score_side is unknown": ("subspace_similarity.score_side", "both", S),
    "phi_u outside 0 to 1": ("subspace_similarity.phi_u", -0.5, S),
    "phi_v outside 0 to 1": ("subspace_similarity.phi_v", 1.5, S),
    "subspace_similarity.s is not that of its side": ("subspace_similarity.s", 0.25, S),
    "group_stats.subspace_score_side differs": ("group_stats.subspace_score_side", "u", S),
    "group_stats.subspace_phi_u differs": ("group_stats.subspace_phi_u", 0.5, S),
    "group_stats.subspace_phi_v differs": ("group_stats.subspace_phi_v", 0.5, S),
    "group_stats.subspace_score differs": ("group_stats.subspace_score", 0.25, S),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "r.jsonl"
    rows = [("good", good(T)), ("good subspace", good(S)), *((m, changed(*how)) for m, how in BROKEN.items())]
    path.write_text("".join(json.dumps({"name": m, **row}) + "\n" for m, row in rows))
    df = spark.read.schema("name string, " + R.SCHEMA).json(str(path))
    return {r["name"]: r["faults"] for r in R.faults(df, N, 1).select("name", "faults").collect()}


def test_every_check_has_a_record(spark):
    assert set(BROKEN) == {m for m, _ in R.checks(N, 1)}
    assert len(BROKEN) == len(R.checks(N, 1)) > 60


def test_good_records(found):
    assert found["good"] == [] and found["good subspace"] == []


@pytest.mark.parametrize("message", BROKEN)
def test_broken_record(found, message):
    assert message in found[message]


def test_zero_and_single(spark):
    """One response: mean 0, deviation 1; an update of zeros isn't eligible; old totals are read."""
    one = changed("group_stats.rewards", [3.0])
    stats = one["group_stats"]
    stats |= {k: v[:1] for k, v in stats.items() if isinstance(v, list)}
    stats |= {"reward_mean": 0.0, "reward_std": 1.0, "advantages": [3.0 / (1 + 1e-6)], "question_tokens": 3, "analysis_truncated_responses": 0}
    stats.pop("total_response_tokens")
    still = changed("matrices.a.frobenius_norm", 0.0, S)
    for at in (still, still["group_stats"]):
        at |= {"marginal_delta_all_zero": True, "selection_eligible": False, "selection_filter_reason": "zero_marginal_delta"}
    df = spark.read.schema(R.SCHEMA).json(spark.sparkContext.parallelize([json.dumps(one), json.dumps(still)]))
    got = [r["faults"] for r in R.faults(df, F.size("group_stats.rewards"), 1).collect()]
    assert got == [[], []]
    assert R.require_valid(df, F.size("group_stats.rewards"), 1).count() == 2
    assert R.fault_counts(df.limit(0), N, 1).collect() == []
    with pytest.raises(PySparkException, match="group_id=7: .*worker_rank is not that of the worker"):
        R.require_valid(df, F.size("group_stats.rewards"), 3).collect()
