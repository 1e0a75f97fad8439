"""The join against all pairs."""

import random

import brute
import pytest

from harrow.llm import jaccard


def sets(text):
    w = brute.WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(src):
    s = [sets(t) for _, t in src]
    n = len(src)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(src[i][0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(((src[i][0], name[find(i)], links[i]) for i in range(n)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["small", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_join(docs):
    src = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_classes(src)
    assert got(jaccard.join_near(docs)) == want
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    firsts = {c for i, c, _ in want}
    assert set(ids) == firsts and len(ids) == len(firsts)


@pytest.mark.parametrize("how", [{}, {"small": 4, "depth": 3}])
def test_large_groups(spark, how, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 8)
    monkeypatch.setattr(jaccard, "CHUNK_SHORT", 7)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(30 if g == 0 else 5):
            t = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(150)] = rng.choice(words)
            rows.append(" ".join(t))
    rows += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(40)]
    src = list(enumerate(rows))
    docs, want = spark.createDataFrame(src, "doc_id long, text string"), brute_classes(src)
    assert got(jaccard.join_near(docs, **how)) == want
    assert sorted(r["doc_id"] for r in jaccard.keep_first(docs, **how).collect()) == sorted({c for _, c, _ in want})


def test_recall(spark):
    """Pairs just over the threshold, of which nearly all must be found."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(150):
        base = [rng.choice(words) for _ in range(100)]
        t = base.copy()
        for i in (20, 70):
            t[i] = "x"
        rows += [" ".join(base), " ".join(t)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = sum(r["n_links"] for r in jaccard.join_near(df).collect()) / 2
    assert len(sets(rows[0]) & sets(rows[1])) / len(sets(rows[0]) | sets(rows[1])) > 0.8
    assert found >= 0.98 * 150


def test_pairs_in_large_buckets(spark):
    assert jaccard.recall(jaccard.runs_at(8), 8) >= jaccard.recall(jaccard.RUNS, 2) > 0.999
    rows = []
    for i in range(300):  # pairs of similarity 89 / 111
        words = [f"w{i}x{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:93] + [f"v{i}x{k}" for k in range(11)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_near(docs, small=1)  # no bucket is small, so all are split to the last level
    assert got.where("n_links = 1").count() >= 0.99 * len(rows)
