"""Every pipeline stage on odd rows, an empty table and clashing column names."""

import brute
import pytest
from pyspark.sql import functions as F

from harrow.llm import jaccard, mixing, pii, quality, queries

SP = queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(params=["odd", "empty"])
def docs(request):
    own = request.getfixturevalue(request.param)
    return own.withColumns({"size": F.lit("x"), "taken": F.lit(None).cast("double"), "set": F.lit(1), "kept": F.lit("?"), "tk": F.lit("t"), "id": F.lit("i")})


def test_quality(docs):
    got = quality.keep_good(docs, SP)
    assert got.columns == docs.columns
    ids = {r["doc_id"] for r in got.collect()}
    assert ids <= {r["doc_id"] for r in docs.collect() if not brute.quality(r["text"])[-1]}


def test_near_copies(docs):
    got = jaccard.keep_first(docs)
    assert got.columns == docs.columns
    texts = [r["text"] for r in got.collect()]
    assert len([t for t in texts if t and t.startswith("The quick")]) == (1 if docs.count() else 0)
    assert {r["text"] for r in docs.where("text is null or text = ''").collect()} <= set(texts)


def test_personal_data(docs):
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert not any(sum(brute.pii(r["text"])[:4]) for r in got.collect())
    assert [r["doc_id"] for r in got.where("text is null").collect()] == [r["doc_id"] for r in docs.where("text is null").collect()]


def test_mixture(docs):
    got = mixing.mix_documents(docs)
    assert got.columns == [c for c in docs.columns if c not in ("size", "taken")] + ["size", "source_size", "target", "taken"]
    plain = sorted((r["doc_id"] is None, r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect() if r["taken"])
    assert sorted((r["doc_id"] is None, r["doc_id"], r["taken"]) for r in got.collect()) == plain


def test_a_worker_gives_its_memory_back():
    """Freed memory below something that is kept goes back to the system."""
    import os

    from harrow.llm import common

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    many = [bytearray(100_000) for _ in range(2000)]
    full, last = resident(), many[-1]
    del many
    common.give_back()
    assert resident() < full - 150_000_000 and len(last) == 100_000
