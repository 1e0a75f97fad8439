"""Token counts by distinct pre-tokens.

A tokeniser cuts a text into pre-tokens and each of them into pieces, so a text's count is the sum
over its pre-tokens. A block of documents cuts its distinct stretches into pre-tokens with the library's own
pre-tokeniser (stretches end before a single space that a non-space follows, where every pre-token ends) and
keeps each document's frequencies as numbers. It asks for the pieces of its distinct pre-tokens, each in the bucket
that has it for the whole corpus; the bucket lets the library count every distinct pre-token once. The answers
meet the frequencies and are summed. Texts are never shuffled and ids of pieces never stored.

Defined results: a null or empty text has no bytes and no tokens; a special token's string counts
one, as the library takes it; repeated rows are each counted; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, common

#: Characters that the library cuts into pre-tokens by one call.
CHUNK = 1 << 16
_HELD: dict[str, object] = {}


def tokenizer(path: str):
    """The tokeniser of a file, held by the worker."""
    if path not in _HELD:
        from tokenizers import Tokenizer

        _HELD[path] = Tokenizer.from_file(path)
    return _HELD[path]


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


#: A space and what is, or was in some version of Unicode, white space; or the end.
_ODD = re.compile(" (?=[\\s\u180e]|$)", re.DOTALL)
_CUT = re.compile("(?= [^\\s\u180e])")


def stretches(text: str) -> list[str]:
    """``text`` cut before each space that a non-space follows."""
    if _ODD.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


def pre_tokens(parts: list[str], path: str) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all stretches by the library, and how many each has. Stretches that begin where a pre-token
    does in any text are cut many at a time; those before the first space of a text one by one."""
    cut = tokenizer(path).pre_tokenizer.pre_tokenize_str
    flat: list[str] = []
    size = np.zeros(len(parts), np.int64)
    starts = [i for i, x in enumerate(parts) if not _CUT.match(x)]
    for a, b in zip([-1, *starts], [*starts, len(parts)], strict=True):
        if a >= 0:
            found = cut(parts[a])
            flat += [parts[a][x:y] for _, (x, y) in found]
            size[a] = len(found)
        i = a + 1
        while i < b:
            long = np.cumsum(np.fromiter(map(len, parts[i : i + CHUNK // 8]), np.int64)[: b - i])
            n = max(1, int(np.searchsorted(long, CHUNK, "right")))
            whole = "".join(parts[i : i + n])
            places = [at for _, at in cut(whole)]
            flat += [whole[x:y] for x, y in places]
            size[i : i + n] = np.bincount(np.searchsorted(long[:n], [x for x, _ in places], "right"), minlength=n)
            i += n
    return flat, size


def _split(text: str, special: list[str]) -> tuple[list[str], int]:
    """The stretches between special strings, and the number of those strings."""
    parts = [text]
    for s in special:
        if s in text:
            parts = [x for p in parts for x in p.split(s)]
    return [s for p in parts for s in stretches(p)] if len(parts) > 1 else stretches(text), len(parts) - 1


def _bucket(keys: list[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) % n for k in keys), np.int64, len(keys))


def _frequencies(texts: list[str], special: list[str], path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pre-tokens; each text's number of special strings and of distinct pre-tokens; these, text by
    text, and how often each is there."""
    number: dict[str, int] = {}
    where, extra = [], []
    for t in texts:
        parts, n = _split(t, special)
        number.update(zip([s for s in dict.fromkeys(parts) if s not in number], itertools.count(len(number))))
        where.append(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)))
        extra.append(n)
    flat, size = pre_tokens(list(number), path)
    known = dict(zip(dict.fromkeys(flat), itertools.count()))
    inner = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    begin = np.cumsum(size) - size
    distinct, index, often = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in where:
        stretch, times = np.unique(w, return_counts=True)
        own = size[stretch]
        found = inner[np.repeat(begin[stretch] - np.cumsum(own) + own, own) + np.arange(int(own.sum()))]
        token, at = np.unique(found, return_inverse=True)
        count = np.bincount(at, np.repeat(times, own), len(token))
        distinct.append(len(token))
        index.append(token)
        often.append(count.astype(np.int64))
    return list(known), np.array(extra, np.int64), np.array(distinct, np.int64), np.concatenate(index), np.concatenate(often)


def _pack(keys: list[bytes]) -> tuple[bytes, bytes]:
    return blocks.squeezed(b"".join(keys)), blocks.squeezed(np.fromiter(map(len, keys), np.uint32, len(keys)).tobytes())


def _unpack(data: bytes, sizes: bytes) -> list[bytes]:
    data, sizes = blocks.unsqueezed(data), blocks.unsqueezed(sizes)
    ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ipc(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    return blocks.squeezed(sink.getvalue().to_pybytes())


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. ``path`` is the tokeniser's file on every machine."""
    special = specials(path)
    size, n = blocks.sizes(docs, text)

    def ask(block: int, rows: pa.Table) -> pa.Table:
        known, extra, distinct, index, often = _frequencies(rows.column("text").to_pylist(), special, path)
        keys = [k.encode() for k in known]
        order, own, first = blocks.by_bucket(_bucket(keys, n))
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys), dtype=np.uint32)
        _, at = common.utf8(common.column(rows, "text"))
        kept = _ipc(pa.table({"id": rows.column("id"), "n_bytes": np.diff(at), "extra": extra, "distinct": distinct}))
        out = [(block, -1 - block % n, kept, blocks.squeezed(place[index].tobytes()), blocks.squeezed(often.astype(np.uint32).tobytes()))]
        return blocks.letters(out + [(block, int(b), *_pack([keys[j] for j in order[first[i] : first[i + 1]]]), None) for i, b in enumerate(own)])

    def count(got: list[dict]) -> list[tuple]:
        if got[0]["bucket"] < 0:  # a block's own frequencies, on their way to the answers
            return [(r["block"], -1, r["a"], r["b"], r["c"]) for r in got]
        sent = [_unpack(r["a"], r["b"]) for r in got]
        keys = list({k for keys in sent for k in keys})
        pieces: dict[bytes, int] = {}
        for i in range(0, len(keys), 8192):
            part = keys[i : i + 8192]
            pieces.update(zip(part, (len(e.ids) for e in tokenizer(path).encode_batch([k.decode() for k in part], add_special_tokens=False)), strict=True))
        return [(r["block"], r["bucket"], blocks.squeezed(np.fromiter(map(pieces.__getitem__, keys), np.uint32, len(keys)).tobytes()), None, None) for r, keys in zip(got, sent, strict=True)]

    def total(block: int, got: dict) -> pa.Table:
        rows = pa.ipc.open_stream(blocks.unsqueezed(got[-1][0])).read_all()
        index, often = (np.frombuffer(blocks.unsqueezed(x), np.uint32) for x in got[-1][1:])
        cost = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(blocks.unsqueezed(got[b][0]), np.uint32) for b in sorted(got) if b >= 0)])
        ends = np.append(0, np.cumsum(rows.column("distinct").to_numpy()))
        sums = np.append(0, np.cumsum(cost[index] * often.astype(np.int64)))
        tokens = rows.column("extra").to_numpy() + sums[ends[1:]] - sums[ends[:-1]]
        return pa.table({id: rows.column("id"), "n_bytes": rows.column("n_bytes"), "n_tokens": tokens, "over_limit": tokens > limit})

    asked = blocks.ask_in_place(docs, id, text, size, ask)
    return blocks.gather(blocks.answer(asked, count), total, f"{id} {dict(docs.dtypes)[id]}, n_bytes long, n_tokens long, over_limit boolean")
