"""Plain versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def pii(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := re.sub(r"[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    names = ("email", "ip", "card", "phone")
    return [sum(x[1] == k for x in out) for k in range(4)] + [sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out)))]


def secrets(text):
    text, out = text or "", []
    p = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    out += [(m.start(), 0, m.end()) for m in p.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ("assign", "access", "hex")
    return [sum(x[1] == k for x in out) for k in range(3)] + [sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out)))]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n]


def repeats(docs, length=50):
    """docs: [(id, text)]; {row: (n_bytes, n_removed, n_spans, sha)}"""
    least = {}
    raw = [((1 << 63) if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def leaks(text, items):
    """items: [(id, text)]"""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    windows = {}
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            windows.setdefault(tuple(x[k : k + 10]), set()).add(str(i))
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                found |= own
                hit |= set(range(k, k + n))
    return [len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)]
