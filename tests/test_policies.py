"""Policy losses by name."""

import math

import pytest

from harrow.operators import losses as L
from harrow.operators import policies as P

SCHEMA = "group_id long, sample_id long, logp double, old_logp double, advantage double, mask int, w double"


def tokens(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_registry(spark):
    assert {"vanilla", "gspo", "gpg", "clip_cov", "kl_cov", "geo_mean"} <= set(P.POLICIES)
    with pytest.raises(ValueError, match="unknown policy"):
        P.policy_loss("none", P.Batch(tokens(spark)))
    held = P.POLICIES["gpg"]
    try:
        P.policy("gpg")(lambda batch, mode: batch.rows.selectExpr("1 as loss", "2 as clipped", "3 as kl", "4 as clipped_lower").limit(1))
        assert tuple(P.policy_loss("gpg", P.Batch(tokens(spark, (1, 1, 0.0, 0.0, 1.0, 1, 1.0)))).first()) == (1.0, 2.0, 3.0, 4.0)
    finally:
        P.policy("gpg")(held)


def test_by_hand(spark):
    rows = tokens(spark, (1, 1, -1.0, -1.5, 1.0, 1, 2.0), (1, 2, -1.0, -1.0, 0.0, 1, 1.0), (1, 3, -9.0, -1.0, 5.0, 0, 1.0), (2, 1, -1.0, -3.0, -1.0, 1, 1.0))
    up, dual = math.exp(0.5), 3.0
    got = P.policy_loss("vanilla", P.Batch(rows)).first()
    assert got["loss"] == pytest.approx((-1.2 + 0 + dual) / 3) and got["clipped"] == pytest.approx(1 / 3) and got["clipped_lower"] == pytest.approx(1 / 3) and got["kl"] == pytest.approx(-2.5 / 3)
    assert P.policy_loss("vanilla", P.Batch(rows, weight="w")).first()["loss"] == pytest.approx((-2.4 + dual) / 3)
    assert P.policy_loss("vanilla", P.Batch(rows), "seq-mean-token-sum").first()["loss"] == pytest.approx((-1.2 + dual) / 2)
    assert P.policy_loss("gpg", P.Batch(rows)).first()["loss"] == pytest.approx(0.0, abs=1e-9)
    # the sequence's steps: 0.25 a token, and 2
    gspo = P.policy_loss("gspo", P.Batch(rows)).first()
    assert gspo["loss"] == pytest.approx((-1.2 / 2 + math.exp(2)) / 2) and gspo["clipped"] == pytest.approx(1 / 3)
    # 0.5 is held at 0.2, a token without advantage counts as a ratio of 1, and a negative advantage holds no large step
    geo = P.policy_loss("geo_mean", P.Batch(rows)).first()
    assert geo["loss"] == pytest.approx((-0.5 * math.exp(0.1) + math.exp(2)) / 2) and (geo["clipped"], geo["clipped_lower"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    weighted = P.policy_loss("geo_mean", P.Batch(rows, weight="w")).first()["loss"]
    assert weighted == pytest.approx((-0.5 * math.exp(0.1) * math.sqrt(2) + math.exp(2)) / 2)
    # the first token has the largest covariance of advantage and log-probability, so it pays
    apart = tokens(spark, (1, 1, -1.0, -1.5, 1.0, 1, 1.0), (1, 2, -2.0, -2.0, 0.0, 1, 1.0), (2, 1, -3.0, -5.0, -0.5, 1, 1.0))
    kl = P.policy_loss("kl_cov", P.Batch(apart), share=0.01).first()
    assert kl["loss"] == pytest.approx((-up + 0.5 + 0.5 * math.exp(2)) / 3) and kl["kl"] == pytest.approx(2.5 / 3)


def test_clip_cov(spark):
    rows = tokens(spark, *((g, s, -1.0 - (g * 7 + s) % 5, -1.0 - (g * 7 + s) % 5, float((g + 3 * s) % 4 - 1.5), 1, 1.0) for g in range(20) for s in range(10)))
    plain = P.policy_loss("clip_cov", P.Batch(rows), share=0.1, low=-0.5, high=9.0).first()
    again = P.policy_loss("clip_cov", P.Batch(rows.repartition(3)), share=0.1, low=-0.5, high=9.0).first()
    assert plain["clipped"] == again["clipped"] and plain["loss"] == pytest.approx(again["loss"]) and 0.03 < plain["clipped"] < 0.2
    none = P.policy_loss("clip_cov", P.Batch(rows), low=90.0, high=91.0).first()
    assert none["clipped"] == 0 and none["loss"] == pytest.approx(P.policy_loss("vanilla", P.Batch(rows)).first()["loss"])


def test_empty(spark):
    got = P.policy_loss("vanilla", P.Batch(tokens(spark))).first()
    assert got["loss"] is None and got["clipped"] is None


def test_tokens_are_dealt_once_at_most(spark):
    """What no sequence is needed for isn't dealt by sequences; what one is, once."""
    batch = P.Batch(tokens(spark, (1, 1, -1.0, -1.5, 1.0, 1, 2.0), (2, 1, -1.0, -3.0, -1.0, 1, 1.0)), weight="w")
    dealt = {n: P.policy_loss(n, batch)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(group_id") for n in ("vanilla", "gpg", "kl_cov", "gspo", "geo_mean")}
    assert dealt == {"vanilla": 0, "gpg": 0, "kl_cov": 0, "gspo": 1, "geo_mean": 1}


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 1.0])
def test_kl_cov_of_many_ties(spark, share):
    """Those of the share by covariance, ties by group and sample, as a plain sort finds them."""
    given = [(g, s, -1.0 - (g * s) % 3, -1.0 - g % 4, float((g + s) % 3 - 1), int((g + s) % 5 > 0), 1.0) for g in range(60) for s in range(10)]
    on = [r for r in given if r[5]]
    a, l = (sum(r[i] for r in on) / (len(on) + 1e-8) for i in (4, 2))
    # the sums' order moves last digits, the same for equal tokens
    top = sorted(on, key=lambda r: (-round((r[4] - a) * (r[2] - l), 9), r[0], r[1]))[: max(1, int(share * len(on)))]
    got = L.kl_cov(tokens(spark, *given).repartition(5), ["group_id", "sample_id"], share=share, beta=1.0)
    extra = {(r.group_id, r.sample_id): r.loss + r.advantage * math.exp(r.logp - r.old_logp) for r in got.collect()}
    paid = {k for k, x in extra.items() if abs(x) > 1e-9}
    assert paid == {(r[0], r[1]) for r in top if r[2] != r[3]} and len(extra) == len(given)
