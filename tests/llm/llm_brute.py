"""Plain Python versions of the operators, for small inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(UP))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def suffix_dedup(rows, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}"""
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def components(rows, percent=75):
    """[(doc_id, n_shingles, component_id)]"""
    return linked({doc: shingles(text) for doc, text in rows}, percent)


def linked(sets, percent=75):
    """[(id, set size, smallest id reachable by links)]"""
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return sorted((doc, len(s), find(doc)) for doc, s in sets.items())


def contained(rows, items, threshold=0.75, k=5):
    out = []
    for (doc, text), (item, it) in itertools.product(rows, items):
        d, q = shingles(text, k), shingles(it, k)
        if q and 1000 * len(d & q) >= round(1000 * threshold) * len(q):
            out.append((doc, item, len(q), len(d & q), len(d & q) / len(q)))
    return sorted(out)


def line_key(line):
    return line.strip(" \t\n\x0b\f\r").translate(UP)


def line_dedup(rows, min_chars=40, min_docs=5):
    """[(doc_id, text, n_lines, n_dropped)]"""
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                held[line_key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(line_key(x), ())) < min_docs or max(d for d in held[line_key(x)] if d is not None) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """{source: target}; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    capped = set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > cap * sizes[s]}
        if not over:
            return t | {s: float(cap * sizes[s]) for s in capped}
        capped |= over


def unigram(rows, modulus=5):
    """[(doc_id, held_out, n_tokens, n_known, N, base)]"""
    tokens = {doc: words(text) + ["\x00end"] for doc, text in rows}
    held = {doc: zlib.crc32(str(doc).encode()) % modulus == 1 for doc, _ in rows}
    c = Counter(t for doc, ts in tokens.items() if not held[doc] for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(
        (doc, held[doc], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        for doc, ts in tokens.items()
    )
