"""Secrets: a worklist that unwraps encoded layers until nothing new appears.

Each whole text is a layer. Tokens that hold URL escapes, Unicode escapes, base64 or hex are
decoded (from each of their first characters, as a prefix may stand before a payload, and over line
breaks), compressed payloads (zlib, gzip, bz2, xz, all members) are opened, and what comes out is a layer of
its own, scanned and unwrapped in turn. A layer that stands in several places is opened once and its
findings are mapped to each of them; within itself it is not opened again, so encodings that decode to
themselves end. Every token has a map from its decoded characters to those of the layer around it, by
which findings are reported where they stand in the text.

Defined results: a null or empty text has no spans; repeated rows are each judged alike; an empty
table gives an empty result; a decoded span within another of its kind is not reported,
but for tokens of single lines that also go on over lines; of bytes that are no text the printable stretches are
scanned; a payload that unpacks to more than ``PIECE`` bytes is scanned in overlapping pieces, however many
(within it, a compressed payload whose encoded token is longer than ``PIECE`` is opened in its first piece
only). An escape of an escape's first character, many times over, is one step, and maps are kept as runs, so such chains cost
their length; mixed chains cost its square. UTF-16 isn't opened. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex")
#: Unpacked bytes of a payload that are scanned at once, and by how much two such pieces overlap.
PIECE, OVERLAP = 64 << 20, 64 << 10
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_HEXED = re.compile(r"[0-9a-fA-F]{24,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: No pattern, and no encoded one, fits into less than 14 characters.
_PRINTED = re.compile(rb"[\t\r\n\x20-\x7e]{14,}")
_INKED = bytes(i if i in b"\t\r\n" or 32 <= i < 127 else 0 for i in range(256))
_URL = re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(r"\\U[0-9A-Fa-f]{8}|\\u\{?[0-9A-Fa-f]{4}\}?|\\x[0-9A-Fa-f]{2}|&#x?[0-9A-Fa-f]{2,5};")
#: Escapes of an escape's own first character, four of them or more: one step leads to the last.
_URL_CHAIN = re.compile(r"%(?:25){4,}")
_UNICODE_CHAIN = re.compile(r"\\(?:U0000005[Cc]|u005[Cc]|x5[Cc]){4,}|&(?:#38;|#x26;){4,}")
_SPACE = re.compile(r"[ \t\r\n]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in one layer."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


class _Source:
    """A stream of bytes that is read in parts and looked into ahead."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.broken = parts, b"", False

    def ahead(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.parts, None)) is not None:
            self.held += more
        return self.held[:n]

    def take(self) -> bytes:
        got, self.held = self.held or next(self.parts, b""), b""
        return got


def _member(source: _Source) -> Iterator[bytes]:
    """What one compressed member holds, up to its end or to damage; ``source`` is left behind it."""
    head = source.ahead(6)
    d = zlib.decompressobj(47) if head[:1] in (b"\x1f", b"\x78") else bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor()
    packed = source.take()
    try:
        while not d.eof:
            out = d.decompress(packed, 1 << 20)
            packed = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
            if out:
                yield out
            elif not packed and not d.eof and not (packed := source.take()):
                source.broken = True
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        source.broken = True
        return
    source.held = d.unused_data + source.held


def _unpacked(parts: Iterator[bytes], heads: frozenset[bytes]) -> Iterator[bytes]:
    """A stream of bytes with the compressed members at its start unpacked, all of them and through any
    depth; one that starts like a stream it came out of is left as it is. A member of up to ``PIECE`` bytes is read as a whole
    before it is looked into, so that streams don't pile up."""
    source, seen = _Source(parts), set(heads)
    open: list[tuple[_Source, bytes]] = [(source, b"")]
    while open:
        source, head = open[-1]
        if _MAGIC.match(source.ahead(6)) and (inner := hashlib.sha256(source.ahead(OVERLAP)).digest()) not in seen:
            member, held, size = _member(source), [], 0
            for part in member:
                held.append(part)
                size += len(part)
                if size > PIECE:
                    break
            seen.add(inner)
            open.append((_Source(itertools.chain([b"".join(held)] if held else [], member)), inner))
            continue
        while part := source.take():
            yield part
        open.pop()
        seen.discard(head)


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """A stream in pieces of about ``PIECE`` bytes. Two pieces overlap, and an encoded token that a piece
    breaks off (unless it is longer than a piece) is repeated from its start."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= PIECE + OVERLAP + len(held[0]):
            piece = b"".join(held)
            yield piece
            token = len(piece.rstrip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"))
            held = [piece[min(token, len(piece) - OVERLAP) if len(piece) - token <= PIECE else len(piece) - OVERLAP :]]
            size = len(held[0])
    if size:
        yield b"".join(held)


def _readable(raw: bytes) -> str | None:
    """All of ``raw`` as a text; None if part of it is none."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 8 and text.replace("\t", " ").replace("\r", " ").replace("\n", " ").isprintable() else None


def _level(raw: bytes, heads: frozenset[bytes]) -> Iterator[tuple[str, int, int] | Iterator]:
    """(text, start, end) of what ``raw`` is: a text, or printable stretches taken as one; and for each payload in it, wherever it
    starts, its place and then an iterator of levels, which must be used up before the next step."""
    if (text := _readable(raw)) is not None:
        yield text, 0, len(raw)
        return
    if found := list(_PRINTED.finditer(raw)):
        yield "\0".join(m.group().decode() for m in found), found[0].start(), found[-1].end()
    at = 0
    while m := _MAGIC.search(raw, at):
        at = m.start() + 1
        head = hashlib.sha256(raw[m.start() : m.start() + OVERLAP]).digest()
        if head in heads:
            continue
        source = _Source(raw[i : i + OVERLAP] for i in range(m.start(), len(raw), OVERLAP))
        behind, some, inside = len(raw), False, heads | {head}

        def levels() -> Iterator[Iterator]:
            nonlocal behind, some

            def members() -> Iterator[bytes]:
                nonlocal behind
                while _MAGIC.match(source.ahead(6)):
                    yield from _unpacked(_member(source), inside)
                behind = len(raw) - len(source.held) - sum(map(len, source.parts))

            for piece in _pieces(members()):
                some = True
                yield _level(piece, inside)

        yield m.start()
        yield levels()
        if some and not source.broken:
            at = behind


def _texts(raw: bytes) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start, end, packed) of what ``raw`` holds: itself if it is a text, else its printable stretches
    as one text, and what its compressed payloads hold, through all depths."""
    stack, place = [_level(raw, frozenset())], 0
    while stack:
        got = next(stack[-1], None)
        if got is None:
            stack.pop()
        elif isinstance(got, int):
            place = got if len(stack) == 1 else place
        elif not isinstance(got, tuple):
            stack.append(got)
        elif len(stack) == 1:
            yield *got, False
        else:
            yield got[0], place, len(raw), True


class _Runs:
    """Where the characters of a decoded token stand in the token: runs that were copied and pieces that were replaced."""

    def __init__(self, pieces: list[tuple[int, int, str]]):
        self.new, self.old, self.end_of = [0], [0], [-1]
        at = moved = 0
        for s, e, text in pieces:
            # a piece of no characters can't be asked for
            for place, old, end in ((moved + s - at, s, e), (moved + s - at + len(text), e, -1)):
                self.new.append(place)
                self.old.append(old)
                self.end_of.append(end)
            moved += s - at + len(text)
            at = e

    def start(self, i: int) -> int:
        k = bisect.bisect_right(self.new, i) - 1
        return self.old[k] if self.end_of[k] >= 0 else self.old[k] + i - self.new[k]

    def end(self, i: int) -> int:
        k = bisect.bisect_right(self.new, i) - 1
        return self.end_of[k] if self.end_of[k] >= 0 else self.old[k] + i - self.new[k] + 1


class _Places:
    """The same of a token over several lines."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        self.first, self.last = first, last

    def start(self, i: int) -> int:
        return int(self.first[i])

    def end(self, i: int) -> int:
        return int(self.last[i]) + 1


def _escaped(token: str, pieces: Iterator[tuple[int, int, str]]) -> tuple[str, _Runs]:
    """``token`` with pieces replaced, and where its characters come from."""
    text, at, known = [], 0, list(pieces)
    for s, e, new in known:
        text += [token[at:s], new]
        at = e
    return "".join([*text, token[at:]]), _Runs(known)


def _url_pieces(token: str) -> Iterator[tuple[int, int, str]]:
    for m in re.finditer(_URL_CHAIN.pattern + r"|(?:%[0-9A-Fa-f]{2})+", token):
        if _URL_CHAIN.fullmatch(m.group()):
            yield m.start(), m.end(), "%"
            continue
        raw = unquote_to_bytes(m.group())
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        if len(text) == len(raw):  # one character for each escape
            yield from ((m.start() + 3 * i, m.start() + 3 * i + 3, c) for i, c in enumerate(text))
        else:
            yield m.start(), m.end(), text


def _unicode_pieces(token: str) -> Iterator[tuple[int, int, str]]:
    for m in re.finditer(_UNICODE_CHAIN.pattern + "|" + _UNICODE.pattern, token):
        s = m.group()
        if _UNICODE_CHAIN.fullmatch(s):
            yield m.start(), m.end(), s[0]
            continue
        n = int(s[3:-1], 16) if s[:3] == "&#x" else int(s[2:-1]) if s[:2] == "&#" and s[2:-1].isdigit() else int(re.sub(r"[^0-9A-Fa-f]", "", s[2:]), 16) if s[0] == "\\" else -1
        if 0 <= n < 0x110000 and not 0xD800 <= n < 0xE000:
            yield m.start(), m.end(), chr(n)


def _tokens(text: str, escape: re.Pattern) -> Iterator[tuple[int, int]]:
    """The stretches between white space that hold an escape."""
    end = 0
    for m in escape.finditer(text):
        if m.start() >= end:
            start = max(end, *(text.rfind(c, end, m.start()) + 1 for c in " \t\r\n"))
            space = _SPACE.search(text, m.end())
            end = space.start() if space else len(text)
            yield start, end


def _decodings(token: str, hexed: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of a token decoded from each of its first four characters (two of hex digits), so that
    whatever stands before a payload is passed over."""
    plain = token.rstrip("=").replace("-", "+").replace("_", "/")
    for p in range(2 if hexed else 4):
        part = plain[p : len(plain) - ((len(plain) - p) % 2 if hexed else (len(plain) - p) % 4 == 1)]
        yield p, bytes.fromhex(part) if hexed else binascii.a2b_base64(part + "=" * (-len(part) % 4))


def _part(token: str, p: int, x: int, y: int, n: int, hexed: bool) -> tuple[int, int]:
    """The part of a token that bytes x to y of the n decoded from place p on stand for, widened to separators."""
    if hexed:
        return p, p + 2 * n
    if p == 0 and x == 0 and y == n:
        return 0, len(token)
    first, last = p + x // 3 * 4, p - (-4 * y // 3)
    start = max(token.rfind(c, 0, first) + 1 for c in "/_-+")
    return start, len(token) if y == n else min(i if (i := token.find(c, last)) >= 0 else len(token) for c in "/_-+")


def _in_token(token: str, at: int, hexed: bool) -> Iterator[tuple]:
    for p, raw in _decodings(token, hexed):
        for text, x, y, packed in _texts(raw):
            start, end = _part(token, p, x, y, len(raw), hexed)
            yield text, at + start, None, end - start, False
            if y - x == len(raw) and not packed:
                return  # all of it is a text


def _in_lines(lines: list[tuple[int, str]], hexed: bool) -> Iterator[tuple]:
    """The same of a token that goes on over several lines. Its text has a map, so that a finding stands at its
    own characters; what was packed stands for the whole part of the token."""
    token = "".join(x for _, x in lines)
    place = np.concatenate([np.arange(at, at + len(x)) for at, x in lines])
    for p, raw in _decodings(token, hexed):
        for text, x, y, packed in _texts(raw):
            if packed:
                start, end = _part(token, p, x, y, len(raw), hexed)
                yield text, int(place[start]), None, int(place[end - 1] + 1 - place[start]), True
            else:
                i = np.arange(len(raw))
                first, last = (p + 2 * i, p + 2 * i + 1) if hexed else (p + i // 3 * 4 + i % 3, p + i // 3 * 4 + i % 3 + 1)
                yield raw.translate(_INKED).decode("ascii"), 0, _Places(place[first], place[last]), 0, True
                if y - x == len(raw):
                    return


def layers_in(text: str) -> Iterator[tuple[str, int, _Runs | _Places | None, int, bool]]:
    """(decoded text, offset, places, length, joined) of every encoded token; without places all of the
    decoded text stands for the whole token of that length. joined: of several lines."""
    for mark, escape, pieces in (("%", _URL, _url_pieces), ("\\", _UNICODE, _unicode_pieces), ("&#", _UNICODE, _unicode_pieces)):
        if mark in text:
            for start, end in _tokens(text, escape):
                inner, places = _escaped(text[start:end], pieces(text[start:end]))
                yield inner, start, places, 0, False
    for pattern, hexed in ((_B64, False), (_HEXED, True)):
        for m in pattern.finditer(text):
            yield from _in_token(m.group(), m.start(), hexed)
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.group()) for x in _LINE.finditer(text, m.start(), m.end())]
        yield from _in_lines(lines, False)
        if all(_HEXED.fullmatch(x) for _, x in lines[:-1]):
            yield from _in_lines([*lines[:-1], (lines[-1][0], re.match("[0-9a-fA-F]*", lines[-1][1]).group())], True)


def _digest(layer: str) -> bytes:
    return hashlib.sha256(layer.encode()).digest()


#: start, kind, end, and whether a token of several lines led there.
Span = tuple[int, int, int, bool]


def _scanned(layer: str) -> set[Span]:
    return {(*x, False) for x in scan(layer)}


def _mapped(found: set[Span], at: int, places: _Runs | _Places | None, length: int, joined: bool) -> set[Span]:
    """Spans of a decoded token where they stand in the layer that holds the token."""
    if places is None:
        return {(at, k, at + length, j or joined) for _, k, _, j in found}
    return {(at + places.start(a), k, at + places.end(b - 1), j or joined) for a, k, b, j in found}


def _outermost(spans: set[Span]) -> set[Span]:
    """``spans`` without those that lie within another of their kind."""
    kept, reach = set(), [-1] * len(KINDS)
    for x in sorted(spans, key=lambda x: (x[0], -x[2], x[3])):
        if x[2] > reach[x[1]]:
            reach[x[1]] = x[2]
            kept.add(x)
    return kept


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, spans found in decoded layers, and how many distinct layers were opened.

    What a layer yields, in its own characters, is kept by the layer's digest and mapped to every place
    where the layer stands. A layer met again while it is open itself is scanned but not opened; what
    a layer yields under such a cut is not kept, unless the cut is its own. Layers that
    stand for a whole token are kept as the kinds they yield."""
    base = scan(text)
    key = _digest(text)
    kept: dict[tuple[bytes, bool], set[Span]] = {}
    opened, depth_of = set(), {key: 0}
    # digest, layer's tokens, spans so far, least depth cut at, token in the outer layer
    work: list[list] = [[key, layers_in(text), _scanned(text), 0, None]]
    while True:
        own = work[-1]
        token = next(own[1], None)
        if token is not None:
            inner, *where = token
            key = _digest(inner)
            whole = where[1] is None
            if (got := kept.get((key, whole))) is not None:
                own[2] |= _mapped(got, *where)
            elif key in depth_of:
                own[3] = min(own[3], depth_of[key])
                own[2] |= _mapped(_scanned(inner), *where)
            else:
                opened.add(key)
                depth_of[key] = len(work)
                work.append([key, layers_in(inner), _scanned(inner), len(work), where])
            continue
        work.pop()
        if not work:
            break
        key, _, found, least, where = own
        del depth_of[key]
        if where[1] is None:
            found = {(0, k, 0, j) for _, k, _, j in found}
        if least >= len(work):
            kept[key, where[1] is None] = found
        else:
            work[-1][3] = min(work[-1][3], least)
        work[-1][2] |= _mapped(found, *where)
    # a token that ends with its line has its own span beside that of the lines together
    added = {x[:3] for x in _outermost({x for x in own[2] if not x[3]}) | _outermost(own[2])}
    return base, sorted(added - set(base)), len(opened)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, counts and digest of the base spans, all spans, layers opened."""

    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_layers")}
        for t in common.column(rows, "text").to_pylist():
            base, added, opened = spans_of(t or "")
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(base + added))
            out["n_layers"].append(opened)
        return pa.table({id: rows.column("id"), **out})

    kind = dict(docs.dtypes)[id]
    return common.arrow_pass(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), run, f"{id} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
