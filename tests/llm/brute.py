"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def repeated_words(docs, k=13):
    """{doc_id: (n_words, n_removed, sha)} of (doc_id, text) rows."""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def repeated_bytes(docs, k=400):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    count = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for s in range(len(b) - k + 1):
            count[hash(b[s : s + k]), b[s : s + 8]] += 1
    out = {}
    for i, b in raw:
        gone, spans, end = bytearray(len(b)), 0, -1
        for s in range(len(b) - k + 1):
            if count[hash(b[s : s + k]), b[s : s + 8]] > 1:
                spans += s > end
                end = s + k
                gone[s : s + k] = b"\x01" * k
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_components(docs, width, percent):
    """{doc_id: (n_shingles, component_id)} with all pairs compared that share a shingle."""
    sets = {i: shingles(t, width) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j > i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}
