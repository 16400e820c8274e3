"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(doc):
    return (doc is None, doc or 0)


def substrings(rows, length, of_words):
    """Sorted (id, symbols, removed, spans, digest of what stays) of (id, text) rows."""
    seqs = [(d, WORD.findall(t or "") if of_words else list((t or "").encode())) for d, t in rows]
    low = {}
    for d, s in sorted(seqs, key=lambda r: order(r[0])):
        for i in range(len(s) - length + 1):
            low.setdefault(tuple(s[i : i + length]), order(d))
    out = []
    for d, s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if low[tuple(s[i : i + length])] < order(d):
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(s, gone, strict=True) if not g]
        data = " ".join(kept).encode() if of_words else bytes(kept)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(s), sum(gone), spans, hashlib.sha256(data).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, n=3):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components(rows, n=3, percent=90):
    """Sorted (id, set size, smallest id reachable) of (id, text) rows."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if find(i) not in least or order(d) < order(least[find(i)]):
            least[find(i)] = d
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)
