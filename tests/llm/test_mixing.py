"""Targets against a plain water-filling, takings against their bounds."""

import random

import brute
import pytest

from harrow.llm import mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.fixture(params=["small", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_mix(docs):
    src = [(r["doc_id"], r["source"], len(brute.WORD.findall(r["text"] or ""))) for r in docs.collect()]
    sizes = {}
    for _, s, n in src:
        sizes[s] = sizes.get(s, 0) + n
    want = fill(sizes)
    got = mixing.mix(docs).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"]) for r in got), key=repr) == sorted(((i, n, sizes[s]) for i, s, n in src), key=repr)
    assert [r["taken"] for r in mixing.mix(docs).orderBy("doc_id", "size", "taken").collect()] == [r["taken"] for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["taken"]))]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    wide = {}
    for (i, s, n) in src:
        wide.setdefault(i, s)
    for s, t in want.items():
        own = [r for r in got if abs(r["target"] - t) <= 1e-6 * max(1, t) and r["source_size"] == sizes[s]]
        assert own
        same = sum(1 for x in want if abs(want[x] - t) <= 1e-6 * max(1, t) and sizes[x] == sizes[s])
        assert abs(sum(r["taken"] for r in own) / same - t) <= max(64, 0.03 * t)


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 10000]) for i in range(rng.randint(1, 12))} | {None: 7}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(fill(sizes))


def test_large_blocks_and_documents(small):
    want = {(r["doc_id"]): r["taken"] for r in mixing.mix(small, slots=200).collect() if r["taken"]}
    got = mixing.mix_documents(small, slots=200)
    assert got.columns == [*small.columns, "size", "source_size", "target", "taken"]
    assert {r["doc_id"]: r["taken"] for r in got.collect()} == want


@pytest.mark.parametrize("slots", [16, 1000])
def test_few_slots_keep_small_sources(spark, slots):
    sizes = {"hot": 4000} | {f"s{i:02}": 3 + 5 * i for i in range(20)} | {None: 9}
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * k)) for i, (s, k) in enumerate((s, k) for s, n in sizes.items() for k in [1] * (n % 10) + [10] * (n // 10))], "doc_id long, source string, text string")
    taken = {r["source"]: r["taken"] for r in mixing.mix(docs, slots=slots).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    assert taken == {s: int(t + 0.5) for s, t in fill(sizes).items()}


def test_positions_follow_the_schedule(spark, monkeypatch):
    """Against walking through the slots one by one; another constant gives other positions and the same words."""
    rng = random.Random(3)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2])}", " ".join(["w"] * rng.randint(1, 9))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one = {r["doc_id"]: r for r in mixing.mix(docs, block=10).collect()}
    taken = {}
    for i, s, _ in rows:
        taken[s] = taken.get(s, 0) + one[i]["taken"]
    blocks = {s: -(-n // 10) for s, n in sorted(taken.items())}
    slots, given, n = {}, {s: 0 for s in blocks}, 0
    while any(given[s] < blocks[s] for s in blocks):
        u, low = (n + 0.5) * mixing._GOLDEN % 1, 0.0
        for s, k in blocks.items():
            if low <= u < low + k / sum(blocks.values()):
                if given[s] < k:
                    slots[n] = s
                given[s] += 1
            low += k / sum(blocks.values())
        n += 1
    assert n <= 2.62 * sum(blocks.values()) + 8
    own = {i: s for i, s, _ in rows}
    first = {}
    for i, r in one.items():
        if r["position"] is None:
            assert not r["taken"]
        else:
            assert slots[r["position"]] == own[i]
            first.setdefault(own[i], set()).add(r["position"])
    # a prefix of the schedule holds the sources in proportion
    for m in (40, 80, len(slots)):
        held = [s for k, s in sorted(slots.items())[:m]]
        assert all(abs(held.count(s) - m * k / sum(blocks.values())) <= 4 for s, k in blocks.items())
    monkeypatch.setattr(mixing, "_GOLDEN", 0.123)
    other = {r["doc_id"]: r for r in mixing.mix(docs, block=10).collect()}
    assert [other[i]["taken"] for i in one] == [one[i]["taken"] for i in one]
    assert [other[i]["position"] for i in one] != [one[i]["position"] for i in one]


def test_late_slots(spark):
    from decimal import Decimal, getcontext

    from pyspark.sql import functions as F

    getcontext().prec = 40
    golden = (Decimal(5).sqrt() - 1) / 2
    ids = [0, 1, 65535, 65536, 10**7 + 3, 3 * 10**10 + 7]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(mixing._point(F.col("id"))).collect()]
    assert got == pytest.approx([float((i + Decimal("0.5")) * golden % 1) for i in ids], abs=1e-9)
