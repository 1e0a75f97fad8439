"""Quality rules by tokeniser fertility: characters per token, byte-fallback share, token entropy.

A public vocabulary with byte fallback cuts each word into pieces. Prose of a language the
vocabulary knows has a narrow band of characters per token; junk, encodings and broken text leave it.
The bands are set per language from all documents that pass the base rules: the median of each measure
and ``reach`` times the distance of the quartiles around it, wider for short texts. The pass over the texts
writes only a few numbers per document, the bands are one aggregation over those, and the verdict is
a join with one row per language.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are each
judged alike; an empty table gives an empty result; a null language is a language of its own; a
language without a document that passes the base rules has no band, so nothing is rejected by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
#: A worker forgets the words that it has cut when it holds this many.
MOST_WORDS = 200_000
#: Languages up to which their bands are broadcast.
MOST_LANGUAGES = 10_000
SHORT = 15.0


class _Pieces:
    """Words of a worker, numbered, each cut into pieces once."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.chars = self.size = self.start = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        texts = [w.decode("utf-8", "replace") for w in words]
        cut = self.model.encode(texts, num_threads=1)
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, texts), np.int64, len(texts))])
        self.ids = np.concatenate([self.ids, np.fromiter((i for c in cut for i in c), np.int32, int(size.sum()))])


_HELD: dict[str, _Pieces] = {}


def _repeated(words: np.ndarray) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    if len(words) < 4:
        return 0
    _, w = np.unique(words, return_inverse=True)
    m = int(w.max()) + 1
    key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    if m > 2_000_000:  # the key would not fit 64 bits
        _, pair = np.unique(w[:-2] * m + w[1:-1], return_inverse=True)
        key = pair * m + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    if not often.any():
        return 0
    hit = np.zeros(len(w), bool)
    for k in range(3):
        hit[k : len(w) - 2 + k] |= often
    return int(hit.sum())


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and the counts and measures of each text,
    their names after ``prefix``."""
    keep = tuple(docs.columns) if keep is None else keep
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kinds = ", ".join([*(f"`{prefix}{n}` long" for n in names), *(f"`{prefix}{n}` double" for n in MEASURES)])
    kept = docs.select(*keep).schema

    def run(rows: pa.Table) -> pa.Table:
        held = _HELD.get(model_path) or _HELD.setdefault(model_path, _Pieces(model_path))
        out: list[list] = []
        texts = [(t or "").encode("utf-8", "replace") for t in common.column(rows, "__text").to_pylist()]
        split = [t.split() for t in texts]  # bytes split at the six ASCII white-space characters
        if len(held.number) > MOST_WORDS:
            held.forget()
        number, new = held.number, []
        for words in split:
            for w in words:
                if w not in number:
                    number[w] = len(number)
                    new.append(w)
        held.learn(new)
        for t, words in zip(texts, split, strict=True):
            w = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            size, chars = held.size[w], int(held.chars[w].sum())
            total = int(size.sum())
            where = np.repeat(held.start[w] - np.cumsum(size) + size, size) + np.arange(total)
            ids = held.ids[where]
            n = np.unique(ids, return_counts=True)[1] / max(total, 1)
            out.append([len(words), chars, len(t.translate(None, _SYMBOLS)), _dup_lines(t), _repeated(w), chars / total if total else None, float(held.is_byte[ids].mean()) if total else None, float(-(n * np.log2(n)).sum()) if total else None])
        cols = list(zip(*out, strict=True))
        table = rows.drop_columns(["__text"])
        for name, values in zip((*names, *MEASURES), cols, strict=True):
            table = table.append_column(prefix + name, pa.array(values, pa.float64() if name in MEASURES else pa.int64()))
        return table

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), kinds])
    return common.arrow_pass(docs.select(*keep, F.col(text).alias("__text")), run, schema)


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * again > 50 * n)


def judge(measured: DataFrame, language: str = "lang", reach: float = 5.0, prefix: str = "") -> DataFrame:
    """``measured`` (read thrice, so written or cheap) and the columns base_failed and kept. Means over a
    text's words scatter by the root of their number, so their distance from the language's median is taken
    times that root; the entropy, which grows with the text, keeps its own scale and gets wider for short ones."""
    p, lang, root = prefix, f"{prefix}__lang", F.sqrt(F.greatest(F.col(f"{prefix}n_words"), F.lit(1)))
    ok = measured.where(~base_failed(p)).withColumn(lang, F.col(language))
    q = lambda x: F.percentile_approx(x, [0.25, 0.5, 0.75], 1000)
    middle = common.cut(ok.groupBy(lang).agg(*(q(p + m)[1].alias(f"{p}__{m}") for m in MEASURES)))
    small = middle.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    held = lambda df: F.broadcast(df) if small else df  # noqa: E731  else the join shuffles
    apart = lambda m: (F.col(p + m) - F.col(f"{p}__{m}")) * (F.lit(1.0) if m == "token_entropy" else root)
    spread = ok.join(held(middle.withColumnRenamed(lang, "__own")), F.col(lang).eqNullSafe(F.col("__own"))).groupBy(lang).agg(*((q(apart(m))[2] - q(apart(m))[0]).alias(f"{p}__{m}_spread") for m in MEASURES))
    bands = common.cut(middle.withColumnRenamed(lang, "__own").join(spread, F.col(lang).eqNullSafe(F.col("__own"))).drop("__own"))
    joined = measured.join(held(bands), measured[language].eqNullSafe(bands[lang]), "left")
    inside = F.lit(True)
    for m in MEASURES:
        least = 0.01 + 0.02 * F.abs(F.col(f"{p}__{m}"))
        room = F.greatest(F.col(f"{p}__{m}_spread"), least) * reach * (1 + SHORT / root if m == "token_entropy" else F.lit(1.0))
        inside &= F.coalesce(F.abs(apart(m)) <= room + (0 if m == "token_entropy" else least * root), F.lit(True))
    return joined.withColumns({f"{p}base_failed": base_failed(p), f"{p}kept": ~base_failed(p) & inside}).drop(*bands.columns)


def rate(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", language: str = "lang", reach: float = 5.0) -> DataFrame:
    """One row per document: id, base counts, measures, base_failed and kept."""
    small = measure(docs.select(F.col(id), F.col(language).alias("lang"), F.col(text).alias("text")), model_path, keep=(id, "lang"))
    return judge(common.cut(small), "lang", reach).drop("lang")


def keep_good(docs: DataFrame, model_path: str, text: str = "text", language: str = "lang", reach: float = 5.0) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns. The measured rows are written once, texts
    included, so that no shuffle carries texts."""
    wide = common.cut(measure(docs, model_path, text, prefix="__q_"))
    return judge(wide, language, reach, prefix="__q_").where("__q_kept").select(*docs.columns)
