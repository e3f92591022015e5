"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(n: int, starts, length: int) -> list[bool]:
    out = [False] * n
    for s in starts:
        out[s : s + length] = [True] * (min(s + length, n) - s)
    return out


def repeated_bytes(rows, length=200):
    """Per row ``(n_bytes, n_removed, n_spans, kept_sha256)``; ``rows`` of ``(doc_id, text)``."""
    texts = [(t or "").encode() for _, t in rows]
    count = defaultdict(int)
    for b in texts:
        for j in range(len(b) - length + 1):
            count[b[j : j + length]] += 1
    out = []
    for b in texts:
        c = covered(len(b), [j for j in range(len(b) - length + 1) if count[b[j : j + length]] > 1], length)
        spans = sum(x and not y for x, y in zip(c, [False, *c], strict=False))
        out.append((len(b), sum(c), spans, sha(bytes(x for x, y in zip(b, c, strict=True) if not y))))
    return out


def copied_words(rows, length=50):
    """Per row ``(n_words, n_removed, kept_sha256)``."""
    key = lambda i: -(1 << 63) if i is None else i
    words = [(key(i), WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - length + 1):
            k = tuple(w[j : j + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        c = covered(len(w), [j for j in range(len(w) - length + 1) if first[tuple(w[j : j + length])] < i], length)
        out.append((len(w), sum(c), sha(" ".join(x for x, y in zip(w, c, strict=True) if not y))))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(rows, similarity=75):
    """Per row ``(n_shingles, component_id, kept)`` for distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= similarity * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(x), find(i), find(i) == i) for i, x in sets]


def contaminated(rows, items, window=10):
    """Per row ``(n_words, n_hit, n_items, items_sha256)``."""
    found = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            found[tuple(w[j : j + k])].add("null" if i is None else str(i))
    out = []
    for _, t in rows:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for k in {len(x) for x in found}:
            for j in range(len(w) - k + 1):
                if own := found.get(tuple(w[j : j + k])):
                    ids |= own
                    hit |= set(range(j, j + k))
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids)))))
    return out
