"""Personal data: span candidates, boosted trees over format and context, calibrated thresholds.

Four base patterns are always redacted. Beside them, generators with high recall propose
spans that the base patterns miss (written-out addresses, loosely grouped numbers, numbers
without a plus). Spark ML fits gradient-boosted trees on all documents that can hold a base span: those with an @ or a digit.
Positive are base spans and the same spans rewritten the way the generators look for, in their own context; negative
are matches that fail their check, these rewritten, and what the generators propose in the texts as they
stand: nobody has labelled those, and counting them as wrong makes the thresholds err on the side of
precision. The features describe format and context, not the check; they are whole numbers of a byte, so that equal examples
are counted and the trees see each once, with its number as weight. Documents, not candidates, are dealt to two halves:
trees of each half score the other, and a threshold for each kind is set for the precision asked for over these scores of all
candidates that thresholds decide on (not over base spans, which stay in any case); the trees that are used are fitted on both. Texts become
feature rows where they are;
trees and thresholds are a small array that every task holds, so that all documents are judged in one pass without a shuffle.

Defined results: a null or empty text has no spans; repeated rows are each judged alike and equal texts count once when
trees are fitted; an empty table gives an empty result; ties between overlapping added spans go to the higher score, then the
earlier start; where a half lacks either class no span is added. Columns beside ``doc_id`` and
``text`` don't matter to :func:`find_spans` and are passed through by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match has its first @ after a run of local characters, so each run is walked once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans that pass, and of the matches that fail."""
    good, bad = [(s, 0, e) for s, e in _emails(text)] if "@" in text else [], []
    for m in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):  # a match takes four numbers of the chain, the next one starts after them
            ok = all(len(p := x.group().lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[i : i + 4])
            (good if ok else bad).append((parts[i].start(), 1, parts[i + 3].end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) > 5:
            (good if 14 <= len(digits) <= 19 and _luhn(digits) else bad).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 10 <= sum(map(str.isdigit, m.group())) <= 15 else bad).append((m.start(), 3, m.end()))
    return sorted(good), bad


_LOOSE = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]| at )\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\.| dot )\s?[A-Za-z0-9-]{2,63})+")),
    (2, re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./-][0-9]{2,6}){2,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:00[1-9]|\(0?[0-9]{2,4}\)|0[1-9])[0-9 ()./-]{6,20}[0-9]")),
)
_HINT = re.compile(r"[0-9]{2}|\(at\)|\[at\]| at .{1,64}(?:\.| dot )")
_WORDS = (re.compile(r"(?i)mail|contact|write"), re.compile(r"(?i)\bip\b|host|server"), re.compile(r"(?i)card|visa|account|iban"), re.compile(r"(?i)phone|tel|call|mobile|fax"))


def candidates(text: str, good: list, bad: list) -> list[tuple[int, int, int]]:
    """Overlapping (start, kind, end) from all generators; those of the base patterns come first."""
    found = dict.fromkeys([*good, *bad])
    if _HINT.search(text):
        for kind, pattern in _LOOSE:
            found.update(dict.fromkeys((m.start(), kind, m.end()) for m in pattern.finditer(text)))
    return list(found)


def features(text: str, start: int, kind: int, end: int) -> bytes:
    """Format and context, each a number from 0 to 255; shares are in 32nds."""
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    n = len(s)
    digits, groups = sum(map(str.isdigit, s)), re.findall(r"[0-9]+", s)
    return bytes((
        kind == 0, kind == 1, kind == 2, kind == 3, min(n, 255), min(digits, 255), 32 * digits // n, 32 * sum(map(str.isalpha, s)) // n,
        min(len(groups), 255), min(max(map(len, groups), default=0), 255), min(min(map(len, groups), default=0), 255), min(s.count("."), 255), min(s.count("-"), 255), min(s.count(" "), 255), min(s.count("("), 255),
        s[:1] == "+", 32 * len(set(s)) // n, left[-1:].isalnum(), right[:1].isalnum(), left[-1:] in "\"'=#_",
        *(bool(w.search(left)) for w in _WORDS),
    ))


N_FEATURES = 24
#: Scores are told apart to one part in this many when thresholds are set.
BINS = 1000
#: Different examples that one task of the trees holds.
FIT_ROWS = 1 << 18
#: Spark ML seeks split points among this many rows squared at least, so among all; a feature has 256 values at most.
MOST_BINS = 46_340


class Model:
    """Trees as arrays (feature, threshold, left, right, value) and a threshold for each kind."""

    def __init__(self, trees: list[list[tuple]], weights: list[float], thresholds: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, x: bytes) -> float:
        total = 0.0
        for nodes, w in zip(self.trees, self.weights, strict=True):
            i = 0
            while nodes[i][0] >= 0:
                i = nodes[i][2] if x[nodes[i][0]] <= nodes[i][1] else nodes[i][3]
            total += w * nodes[i][4]
        return 1 / (1 + np.exp(-2 * total))


def _tree(node) -> list[tuple]:
    nodes: list[tuple] = []

    def walk(x) -> int:
        at = len(nodes)
        nodes.append(())
        if x.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, 0, 0, x.prediction())
        else:
            split = x.split()
            left, right = walk(x.leftChild()), walk(x.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
        return at

    walk(node)
    return nodes


def _rewritten(kind: int, span: str) -> str | None:
    """A base span as the loose generators look for it; None for kinds without one."""
    if kind == 0:
        name, _, domain = span.partition("@")
        return f"{name} (at) {domain.replace('.', ' (dot) ')}"
    if kind == 2:
        digits = re.sub("[^0-9]", "", span)
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return "00" + span[1:].lstrip("0") if kind == 3 else None


def examples(text: str) -> Iterator[bytes]:
    """Kind, whether a threshold decides on it, label and features, a byte each, of a text's candidates and of rewritten ones."""
    good, bad = base_spans(text)
    taken = [(s, e) for s, _, e in good]
    for label, spans in ((1, good), (0, bad)):
        for start, kind, end in spans:
            yield bytes((kind, label == 0, label)) + features(text, start, kind, end)
            new = _rewritten(kind, text[start:end])
            if new is not None:
                around = text[max(0, start - 80) : start] + new + text[end : end + 80]
                at = min(start, 80)
                for k, pattern in _LOOSE:
                    if k == kind:
                        for m in pattern.finditer(around):
                            if m.start() < at + len(new) and m.end() > at:
                                yield bytes((kind, True, label)) + features(around, m.start(), kind, m.end())
    for start, kind, end in candidates(text, [], []):
        if all(end <= s or start >= e for s, e in taken):
            yield bytes((kind, True, 0)) + features(text, start, kind, end)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(half, example, n): the examples of all different texts that can hold a base span, which takes an @ or a digit, and how often
    each stands in those of a half. What the generators propose in other texts has no label beside it, so says nothing."""

    def run(rows: pa.Table) -> pa.Table:
        texts = zip(rows.column("h").to_pylist(), rows.column("t").to_pylist(), strict=True)
        out = [(h, x, n) for h, t in texts for x, n in Counter(examples(t)).items()]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("h", "example", "n"), cols, (pa.int64(), pa.binary(), pa.int64()), strict=True)})

    texts = docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.contains("t", F.lit("@")) | F.col("t").rlike("[0-9]"))
    found = common.arrow_pass(texts, run, "h long, example binary, n long").distinct()
    return found.groupBy(F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(2)).cast("int").alias("half"), "example").agg(F.sum("n").alias("n"))


def _grown(rows: DataFrame, rounds: int, depth: int) -> Model:
    """Trees fitted on rows (example, x, label, n). Up to ``FIT_ROWS`` different examples are summed up by one task, in their order, so that reruns agree."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    train = rows.groupBy("example").agg(F.first("x").alias("x"), F.first("label").alias("label"), F.sum("n").cast("double").alias("n"))
    train = train.coalesce(-(-rows.count() // FIT_ROWS)).sortWithinPartitions("example").select(array_to_vector("x").alias("features"), "label", "n").cache()
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=MOST_BINS, seed=7, cacheNodeIds=False, weightCol="n").fit(train)
    train.unpersist()
    return Model([_tree(t._call_java("rootNode")) for t in fitted.trees], list(fitted.treeWeights), [2.0] * len(KINDS))


def fit(docs: DataFrame, text: str = "text", train_documents: int | None = None, precision: float = 0.95, rounds: int = 12, depth: int = 3) -> Model | None:
    """Fit on all documents that can hold a base span, or on about ``train_documents`` of them where a caller asks for fewer: those whose text's hash is in
    a share of all hashes that holds so many on average. None if a half holds only one class."""
    if train_documents is not None:
        share = min(1.0, train_documents / max(1, docs.count()))
        docs = docs.where(F.xxhash64(text) <= -(1 << 63) + int((1 << 64) * share) - 1)

    def unpacked(rows: pa.Table) -> pa.Table:
        flat = np.frombuffer(b"".join(rows.column("example").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * N_FEATURES), pa.array(flat[:, 3:].reshape(-1).astype(np.float64)))
        return rows.append_column("kind", pa.array(flat[:, 0].astype(np.int32))).append_column("open", pa.array(flat[:, 1] == 1)).append_column("label", pa.array(flat[:, 2].astype(np.float64))).append_column("x", x)

    found = common.cut(common.arrow_pass(counted(docs, text), unpacked, "half int, example binary, n long, kind int, open boolean, label double, x array<double>"))
    if found.groupBy("half").agg(F.countDistinct("label").alias("n")).where("n = 2").count() < 2:
        return None
    halves = [_grown(found.where(F.col("half") == k), rounds, depth) for k in (0, 1)]
    model = _grown(found, rounds, depth)

    def score(rows: pa.Table) -> pa.Table:
        bins = [int(halves[1 - h].score(x[3:]) * BINS) for h, x in zip(rows.column("half").to_pylist(), rows.column("example").to_pylist(), strict=True)]
        return pa.table({"kind": rows.column("kind"), "bin": pa.array(bins, pa.int32()), "label": rows.column("label"), "n": rows.column("n")})

    scored = common.arrow_pass(found.where("open").select("half", "example", "kind", "label", "n"), score, "kind int, bin int, label double, n long")
    bins: dict[int, list] = {k: [] for k in range(len(KINDS))}
    for r in scored.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).orderBy(F.desc("bin")).collect():  # at most BINS + 1 rows of a kind
        bins[r["kind"]].append((r["bin"], r["n"], r["right"]))
    for kind, own in bins.items():
        n = right = 0.0
        for bin, more, good in own:
            n, right = n + more, right + good
            if right >= precision * n and 2 * bin >= BINS:
                model.thresholds[kind] = bin / BINS
    return model


def spans_of(text: str, model: Model | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the model adds; an added span overlaps no other."""
    good, bad = base_spans(text)
    if model is None:
        return good, []
    kept = [(s, e) for s, _, e in good]
    scored = sorted((-model.score(features(text, *c)), *c) for c in candidates(text, good, bad) if c not in set(good)) if bad or _HINT.search(text) else []
    added = []
    for score, start, kind, end in scored:
        if -score >= model.thresholds[kind] and all(end <= s or start >= e for s, e in kept):
            kept.append((start, end))
            added.append((start, kind, end))
    return good, sorted(added)


def written(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", model: Model | None = None, **fit_args) -> DataFrame:
    """One row per document: id, counts and digest of its base spans, all spans, count of added ones."""
    model = model or fit(docs, text, **fit_args)

    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")}
        for t in common.column(rows, "text").to_pylist():
            base, added = spans_of(t or "", model)
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(written(base, KINDS).encode()).hexdigest())
            out["spans"].append(written(base + added, KINDS))
            out["n_added"].append(len(added))
        return pa.table({id: rows.column("id"), **out})

    kind = dict(docs.dtypes)[id]
    return common.arrow_pass(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), run, f"{id} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text: str = "text", model: Model | None = None, **fit_args) -> DataFrame:
    """All columns of ``docs``; each span in ``text`` is replaced by its kind in brackets, ``n_chars``,
    if there is one, follows. A null text stays null."""
    model = model or fit(docs, text, **fit_args)
    schema = docs.schema

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base, added = spans_of(t, model)
        out, at = [], 0
        for s, k, e in sorted(base + added):
            if s >= at:
                out += [t[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join(out) + t[at:]

    def run(rows: pa.Table) -> pa.Table:
        cleaned = [clean(t) for t in common.column(rows, text).to_pylist()]
        rows = common.with_columns(rows, **{text: (pa.string(), cleaned)})
        if "n_chars" in rows.column_names:
            rows = common.with_columns(rows, n_chars=(pa.int64(), [None if t is None else len(t) for t in cleaned]))
        return rows

    return common.arrow_pass(docs, run, schema)
