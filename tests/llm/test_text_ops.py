"""Ops 2, 3, 5, 6, 9 and 10 against plain versions, on a whole small table and on odd rows."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import brute
import numpy as np
import pyarrow as pa
import pytest

from harrow.llm import decontam, pii, quality, queries, secrets, suffix, tokens

SP = queries.vocabulary("piece_bpe_32k.model")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def source(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["small", "odd", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_pii(docs):
    got = rows(pii.find_spans(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(((i, *brute.pii(t)) for i, t in source(docs)), key=repr)


def test_pii_adds_and_redacts(spark):
    texts = [f"please mail user{i}.x@mail{i}.example.com or phone +49 30 {1000000 + i * 7} now, order 12{i} 99{i} of 2020 id 300.400.1.{i}" for i in range(80)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    model = pii.fit(docs)
    assert model is not None and len(model.trees) == 12
    found = pii.find_spans(docs, model=model).collect()
    assert all(r["n_email"] == 1 and r["n_phone"] == 1 and "email:" in r["spans"] for r in found)
    out = pii.redact(docs, model=model).collect()
    assert all("[EMAIL]" in r["text"] and "@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in out)


def test_pii_added_spans_are_right(spark):
    """Written-out addresses among look-alikes: what is added has to be right in 95 of 100 cases, and most are found."""
    rng = np.random.default_rng(4)
    names, hosts = [f"{a}{b}" for a in "abcdefgh" for b in ("lex", "nna", "mil")], ["mail", "post", "web", "box"]
    prose = "the report of last year was read by all of the members and kept for later use".split()
    texts, truth = [], []
    for i in range(1500):
        words = [str(rng.choice(prose)) for _ in range(30)]
        name, host, kind = rng.choice(names), rng.choice(hosts), i % 5
        inside = [f"write to {name}@{host}.org", f"write to {name} (at) {host} (dot) org", f"version 2.10.{i % 90}.7 of {i}", f"numbers 12{i % 10}.34.56 at page {i}", f"contact {name}.x@{host}.com now"][kind]
        text = " ".join([*words[:15], inside, *words[15:]])
        texts.append((i, text))
        at = text.index(f"{name} (at)") if kind == 1 else -1
        truth.append(f"email:{at}:{at + len(inside) - len('write to ')}" if kind == 1 else None)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    added = {}
    for r in pii.find_spans(docs, train_documents=10**9).collect():
        base = {x for x in ("email", "ip", "card", "phone") if r["n_" + x]}
        if r["n_added"]:
            added[r["doc_id"]] = [x for x in r["spans"].split(",") if x.split(":")[0] not in base or r["doc_id"] % 5 == 1]
    right = sum(truth[i] in xs for i, xs in added.items())
    assert right >= 0.95 * sum(map(len, added.values())) and right >= 0.8 * 300


def test_pii_is_fitted_on_all_documents(spark):
    """Few of very many documents hold personal data; every example of every different text counts."""
    rare = [f"please mail user{i}.x@mail{i}.example.com now" for i in range(8)]
    texts = [rare[i // 3000] if i % 3000 == 0 else f"order 12{i} 99{i % 7} of 2020" for i in range(24000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50]])], "doc_id long, text string")
    assert pii.fit(docs, rounds=2) is not None
    got = {bytes(r["example"]): r["n"] for r in pii.counted(docs).groupBy("example").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == Counter(x for t in set(texts) for x in pii.examples(t))


def test_secrets(docs):
    got = rows(secrets.find_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == sorted(((i, *brute.secrets(t)) for i, t in source(docs)), key=repr)


def test_secret_layers():
    inner = "password=correcthorse99"
    for wrap in (
        lambda s: quote(s, safe="").replace("=", "%3D"),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: s.encode().hex(),
        lambda s: quote(base64.b64encode(gzip.compress(quote(s, safe="").encode())).decode(), safe=""),
    ):
        token = wrap(inner)
        base, added, opened = secrets.spans_of(f"see {token} there")
        assert opened and any(k == 0 and 4 <= s and e <= 4 + len(token) for s, k, e in added), token
    start = len("x ")
    base, added, _ = secrets.spans_of("x a%20password%3Dcorrecthorse99%20b")
    assert added == [(start + 4, 0, start + 4 + len("password%3Dcorrecthorse99"))]
    assert secrets.spans_of("%2525252541%41 aGVsbG8gd29ybGQgaGVsbG8gd29ybGQ=")[2] > 1

def test_secrets_behind_very_many_layers():
    """Members 5,000 deep, and chains of escaped escapes; within two seconds on a common machine."""
    packed = b"password=hunter2hunter2 and more"
    for _ in range(5000):
        packed = zlib.compress(packed, 1)
    token = base64.b64encode(packed).decode()
    chains = ["%" + "25" * 10000 + "41bcdefgh1", "\\" + "u005c" * 4000 + "u0041bcdefgh1", "&" + "#38;" * 5000 + "#65;bcdefgh1", "\\" + "U0000005c" * 9 + "U00000041bcdefgh1"]
    assert secrets.spans_of(token)[1] == [(0, 0, len(token))]
    for chain in chains:
        text = "a secret=" + chain
        assert secrets.spans_of(text)[1] == [(2, 0, len(text))]


def test_secrets_in_random_nestings():
    """Against opening every token again wherever it stands."""
    rng = random.Random(12)

    def plain(layer, open):
        found = {(*x, False) for x in secrets.scan(layer)}
        for inner, *where in secrets.layers_in(layer):
            got = {(*x, False) for x in secrets.scan(inner)} if inner in open else plain(inner, open | {inner})
            found |= secrets._mapped(got, *where)
        return found

    wraps = [
        lambda t: "".join(f"%{b:02x}" if rng.random() < 0.4 else chr(b) for b in t.encode()) if t.isascii() else t,
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: t.encode().hex(),
        lambda t: "".join(f"\\u{ord(c):04x}" if rng.random() < 0.3 else c for c in t),
        lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    ]
    for _ in range(60):
        text = f"token={rng.randrange(1 << 60):016x}{rng.randrange(1 << 60):016x}"
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(["", "see ", "x/"]) + rng.choice(wraps)(text) + rng.choice(["", " end"])
        base, added, _ = secrets.spans_of(text)
        found = plain(text, frozenset([text]))
        want = {x[:3] for x in secrets._outermost({x for x in found if not x[3]}) | secrets._outermost(found)}
        assert set(added) == want - set(base)


def test_secrets_in_every_copy():
    plain = "password=correcthorse99"
    twice = base64.b64encode(base64.b64encode(plain.encode())).decode()
    inside = quote(base64.b64encode(plain.encode()).decode(), safe="").replace("b", "%62")
    for token in (twice, inside):
        text = f"a {token} b\nc {token} d\n{token}"
        _, added, opened = secrets.spans_of(text)
        places = [m.start() for m in re.finditer(re.escape(token), text)]
        assert all(any(k == 0 and p <= s and e <= p + len(token) for s, k, e in added) for p in places), token
        assert opened == secrets.spans_of(token)[2]  # copies cost no opening


@pytest.mark.parametrize("case", ["path", "key", "glued", "hex", "lines", "pem", "bad byte", "members", "large"])
def test_secrets_in_odd_payloads(case):
    plain = b"password=correcthorse99"
    code = lambda raw: base64.b64encode(raw).decode()
    noise = np.random.default_rng(1).bytes(200)
    token = {
        "path": code(plain),
        "key": code(gzip.compress(plain)),
        "glued": code(plain),
        "hex": plain.hex(),
        "lines": base64.encodebytes(gzip.compress(noise.hex().upper().encode() + b" " + plain)).decode().strip(),
        "pem": base64.encodebytes(noise + plain + noise).decode().strip(),
        "bad byte": code(b"caf\xe9 \x00" + plain),
        "members": code(gzip.compress(b"hello") + gzip.compress(b" again, " + plain)),
        "large": code(gzip.compress(b"\n" * (66 << 20) + plain)),
    }[case]
    before = {"path": "https://host.example/a/path/", "key": "some_id-", "glued": "xy", "hex": "id", "pem": "-----BEGIN PRIVATE KEY-----\n"}.get(case, "see ")
    _, added, _ = secrets.spans_of(before + token)
    first = len(before) - 2 * (case == "glued")
    assert any(k == 0 and first <= s and e <= len(before) + len(token) for s, k, e in added)


def test_secrets_on_lines_of_their_own():
    token = base64.b64encode(gzip.compress(b"password=correcthorse99 ")).decode().rstrip("=")
    added = secrets.spans_of(f"{token}\n{token}")[1]
    assert {(0, 0, len(token)), (len(token) + 1, 0, 2 * len(token) + 1)} <= set(added)


def test_quality(docs):
    got = rows(quality.rate(docs, SP), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute.quality(t)) for i, t in source(docs)), key=repr)


def test_quality_verdict(spark):
    good = [" ".join(["the market and the people of this city were very happy about it"] + [f"number {(i * j) % 97} of {w} people said the {w}s walked to town {j}" for j, w in enumerate("red tall good fast young old new happy small great cold warm".split())]) for i in range(1, 61)]
    junk = " ".join("ሀጃᐅ" * 3 + str(i) for i in range(80))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, junk])], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.keep_good(docs, SP).collect()}
    assert kept == set(range(60))
    assert quality.keep_good(docs, SP).columns == docs.columns


def test_suffix(docs):
    got = rows(suffix.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    src = source(docs)
    assert got == sorted(((i, *x) for (i, _), x in zip(src, brute.repeats(src))), key=repr)


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffix_hot(spark, hot):
    rng = np.random.default_rng(3)
    line = "this very line of licence text stands in every document of the corpus, whatever else it says. "
    texts = ["".join(rng.choice(list("abcdefgh "), 80)) + line + "".join(rng.choice(list("abcdefgh "), 90)) for _ in range(60)] + ["ab" * 100, "ab" * 70]
    src = list(enumerate(texts))
    got = rows(suffix.remove_repeats(spark.createDataFrame(src, "doc_id long, text string"), hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *x) for (i, _), x in zip(src, brute.repeats(src))), key=repr)


def test_stretches_do_not_depend_on_the_order_of_texts(monkeypatch):
    monkeypatch.setattr(suffix, "_STEP", 256)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc "), rng.integers(0, 900))) for _ in range(40)]

    def found(texts):
        s = suffix._Strings(pa.array(texts))
        raw = s.raw.tobytes()
        return sorted(raw[a : b + 49] for a, b in zip(s.start.tolist(), s.stop.tolist()))

    assert found(texts) == found(texts[::-1]) == found(sorted(texts))


def test_suffix_copies(spark):
    """Copies of a text meet in one block, which has it once; the least id keeps it, whatever the other rows of that id are."""
    from harrow.llm import blocks

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdef ", k=n)) for n in (49, 50, 51, 120, 300)] + ["x" * 80, "", "é" * 25, "é" * 24]
    texts.append("q" + texts[3][:100])  # shares strings with a text that has copies
    src = [(i, t) for i, t in enumerate(texts * 7)] + [(3, texts[3]), (None, texts[4]), (None, texts[4]), (None, "z" * 60), (None, "z" * 60), (None, None), (5, None), (-4, texts[2])]
    rng.shuffle(src)
    df = spark.createDataFrame(src, "doc_id long, text string").repartition(5)
    got = rows(suffix.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    first, strings = {}, lambda t: [t[k : k + 50] for k in range(len(t) - 49)]
    key = lambda i: math.inf if i is None else i
    for i, t in src:
        for x in strings((t or "").encode()):
            first[x] = min(first.get(x, math.inf), key(i))
    want = []
    for i, t in src:
        raw = (t or "").encode()
        gone = {k + d for k, x in enumerate(strings(raw)) if first[x] < key(i) for d in range(50)}
        spans = sum(k - 1 not in gone for k in gone)
        want.append((i, len(raw), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in gone)).hexdigest()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    packed, _ = blocks.blocked(df, "doc_id", "text", suffix.LENGTH)
    where = Counter()
    for _, part in packed.toPandas().groupby("block"):
        block = blocks._unpacked(pa.table({"data": pa.array(part["data"], pa.binary())}))
        where.update(block.texts.to_pylist())
    assert all(n == 1 for t, n in where.items() if len(t.encode()) >= suffix.LENGTH)


def test_suffix_order():
    rng = np.random.default_rng(5)
    for _ in range(60):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 120))
        assert suffix.suffix_order(t, 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        parts = [t[i : i + 7].tolist() for i in suffix.suffix_order(t, 7)]
        assert parts == sorted(parts)


def test_tokens(docs):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = rows(tokens.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    t = tokens.tokenizer(path)
    n = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in source(docs)]
    assert got == sorted(((*x, x[2] > 512) for x in n), key=repr)


def test_tokens_of_all_planes(monkeypatch):
    """Random strings of all of Unicode, white space of all kinds and contractions between."""
    path = queries.vocabulary("byte_bpe_50k.json")
    t, rng = tokens.tokenizer(path), np.random.default_rng(8)
    blank = [chr(i) for i in range(0x3001) if chr(i).isspace()] + ["\u180e", "\u200b", "\ufeff", " ", " ", "  ", "\n"]
    whole = ["'ll", "'s", "don't", "a", "Z", "1", "$", "<|endoftext|>"]

    def one() -> str:
        kind = rng.integers(4)
        if kind == 0:
            return str(rng.choice(blank))
        if kind == 1:
            return str(rng.choice(whole))
        n = int(rng.integers(0x300 if kind == 2 else 0x110000))
        return " " if 0xD800 <= n < 0xE000 else chr(n)

    texts = ["".join(one() for _ in range(rng.integers(1, 14))) for _ in range(20_000)] + ["\ua7dd'll", "", " ", "a  b"]
    monkeypatch.setattr(tokens, "CHUNK", 500)
    known, extra, distinct, index, often = tokens._frequencies(texts, tokens.specials(path), path)
    cost = np.array([len(e.ids) for e in t.encode_batch(known, add_special_tokens=False)])
    sums = np.append(0, np.cumsum(cost[index] * often))
    ends = np.append(0, np.cumsum(distinct))
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert (extra + sums[ends[1:]] - sums[ends[:-1]]).tolist() == want


def test_decontamination(docs, spark):
    src = source(docs)
    whole = next((t for _, t in src if t and len(t) > 400), "")
    items = [(1, whole[40:300]), (2, "One TWO"), (3, None), (4, "..."), (5, "seven wizards quietly brew a strange potion in the cellar the quick brown"), (6, "x"), (12, whole[60:220])]
    items += [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute.leaks(t, items)) for i, t in src), key=repr)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontam.find_items(docs, bench), *cols) == want
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and rows(clean, "doc_id") == sorted(((x[0],) for x in want if not x[-1]), key=repr)


def test_decontamination_in_blocks(small, spark, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = rows(decontam.find_items(small, bench), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontam, "PATTERN_BYTES", 30_000)
    assert rows(decontam.find_items(small, bench), "doc_id", "n_hit", "items_sha256") == one
