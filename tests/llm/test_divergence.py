"""The audit against counting term by term."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from harrow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(src, least=30, top=50):
    docs, times = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in src:
        words = TERM.findall((text or "").translate(LOWER))
        times[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, source in times:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: c for (l, s), c in times.items() if l == lang}
        of["", None] = sum(of.values(), Counter())
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s, c in of.items()}
        pairs = sorted((-sum(abs(p[source][t] - p[s][t]) for t in kept), s.encode()) for s in of if s != source and isinstance(s, str))
        terms = sorted((p["", None][t] - p[source][t], t.encode()) for t in kept if of[source][t] and p[source][t] > p["", None][t])[:top]
        for part, rows in (("pair", pairs), ("term", terms)):
            out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(rows)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("name", "least"), [("small", 30), ("small", 3), ("odd", 30), ("odd", 1), ("empty", 1)])
def test_tables(name, least, request):
    docs = request.getfixturevalue(name)
    src = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    out = divergence.audit(docs.withColumnRenamed("doc_id", "item"), least_docs=least, top=7)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(out) == brute(src, least, 7)


def test_many_blocks_and_strips(small, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 64)
    monkeypatch.setattr(divergence, "STRIP", 9)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 40)
    src = [tuple(r) for r in small.select("lang", "source", "text").collect()]
    assert got(divergence.audit(small, least_docs=3)) == brute(src, 3)


@pytest.mark.parametrize("strip", [1, 5, 1000])
def test_products(strip, monkeypatch):
    monkeypatch.setattr(divergence, "STRIP", strip)
    rng = np.random.default_rng(strip)
    n = rng.integers(0, 4, (30, 6))
    n[:, 4] = 0
    price = n * 7 + 1
    group, term = np.nonzero(n.T)
    want = np.abs(price[:, :, None] - price[:, None, :]).sum(axis=0)
    assert (divergence.joint_prices(term, group, n[term, group], price[term, group], np.ones(6, np.int64)) == want).all()


def test_large_numbers(spark):
    frame = spark.createDataFrame([(10**14, 10**15, 10**9), (0, 0, 0)], "n long, total long, terms long")
    assert [r[0] for r in frame.select(divergence.price("n", "total", "terms")).collect()] == [1 + 10**9 * (10**14 + 5) // (10**15 + 5 * 10**9), None]
