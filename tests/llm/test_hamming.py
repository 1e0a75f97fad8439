"""The Hamming join against all pairs."""

import random

import pytest
from brute import WORD
from pyspark.sql import functions as F

from harrow.llm import common, hamming, jaccard

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sets(text):
    w = WORD.findall((text or "").translate({ord(c): c.lower() for c in UPPER}))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute(src):
    s = [sets(t) for _, t in src]
    root = list(range(len(src)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(src)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(src)):
        least.setdefault(find(i), []).append(src[i][0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(((src[i][0], len(s[i]), name[find(i)], src[i][0] == name[find(i)]) for i in range(len(src))), key=repr)


def edited(rng, base, words, most):
    t = base.copy()
    for _ in range(rng.randint(0, most)):
        t[rng.randrange(len(t))] = rng.choice(words)
    return t


@pytest.fixture(scope="module")
def crowd():
    """Groups of edited copies, chains of copies of copies, and texts that share long passages."""
    rng = random.Random(4)
    words = [f"W{i}" for i in range(800)]
    rows = []
    for g in range(5):
        base = [rng.choice(words) for _ in range(160)]
        for _ in range(40 if g < 2 else 6):
            rows.append(edited(rng, base, words, 5))
    chain = [rng.choice(words) for _ in range(160)]
    for _ in range(25):
        chain = edited(rng, chain, words, 4)
        rows.append(chain)
    passage = [rng.choice(words) for _ in range(90)]
    rows += [passage + [rng.choice(words) for _ in range(60)] for _ in range(40)]
    rows = [" ".join(r) for r in rows]
    rows += [r.lower() for r in rows[:5]] + [rows[3]] * 3
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("name", ["small", "odd", "empty"])
def test_tables(name, request):
    docs = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in hamming.link(docs).collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("small", [2048, 6])
def test_large_buckets(spark, crowd, small, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 8)
    monkeypatch.setattr(jaccard, "CHUNK_SHORT", 7)
    docs = spark.createDataFrame(crowd, "doc_id long, text string")
    assert sorted((tuple(r) for r in hamming.link(docs, small=small).collect()), key=repr) == brute(crowd)


@pytest.mark.parametrize("small", [2048, 6])
def test_every_pair_within_the_distance(spark, crowd, small):
    """The guarantee itself: the edges connect all signatures at most 21 coordinates apart, and only likely ones are edges."""
    docs = spark.createDataFrame(crowd, "doc_id long, text string")
    points = jaccard._points(jaccard.named_rows(docs, "doc_id", "text"), 3, True).groupBy("set").agg(F.max("sketch").alias("sketch"))
    rows = points.collect()
    sketch = hamming._signatures(points.toArrow())
    keys = [bytes(r["set"]) for r in points.toArrow().to_pylist()]
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in hamming.near_pairs(points, small=small).collect():
        up[find(bytes(u))] = find(bytes(v))
    assert len(rows) == len(keys)
    for i in range(len(keys)):
        for j in range(i):
            if (sketch[i] != sketch[j]).sum() <= 2 * hamming.CHUNKS - 1:
                assert find(keys[i]) == find(keys[j])


def test_chance_to_miss():
    assert hamming.miss() < 1.1e-4 and hamming.miss(0.9) < 2e-7


def test_small_tables_are_few_files(spark):
    """Whatever the number of shuffle partitions is, some thousand rows are written by as many tasks as there are cores."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = common.cut(spark.range(4000).groupBy("id").count(), 4000)
        assert len(table.inputFiles()) <= spark.sparkContext.defaultParallelism and table.count() == 4000
        pairs = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(0, 200) if i % 10 < 9], "u binary, v binary").repartition(40)
        found = jaccard.components(pairs)
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {(bytes(r["v"])[0], bytes(r["root"])[0]) for r in found.collect()} == {(i, i - i % 10) for i in range(200)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
