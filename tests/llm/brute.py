"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def contamination(docs, items, window=10):
    """Per ``(doc_id, text)``: words, hit words, item ids with an occurring window."""

    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(_LOWER))

    patterns = []
    for item_id, text in items:
        of_item = words(text)
        size = min(window, len(of_item))
        patterns += [(str(item_id), of_item[i : i + size]) for i in range(len(of_item) - size + 1) if size]
    out = []
    for doc_id, text in docs:
        of_doc, hit, found = words(text), set(), set()
        for item_id, pattern in patterns:
            for i in range(len(of_doc) - len(pattern) + 1):
                if of_doc[i : i + len(pattern)] == pattern:
                    hit.update(range(i, i + len(pattern)))
                    found.add(item_id)
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(of_doc), len(hit), len(found), names, bool(hit)))
    return out


def repeats(docs, span=50):
    """Per ``(doc_id, text)``: bytes, removed bytes, removed runs, bytes kept."""
    first = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - span + 1):
            piece = data[i : i + span]
            if doc_id is not None:
                first[piece] = min(first.get(piece, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - span + 1):
            if doc_id is not None and first.get(data[i : i + span], math.inf) < doc_id:
                gone[i : i + span] = [True] * span
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(b and not a for a, b in zip([False, *gone], gone))
        out.append((doc_id, len(data), sum(gone), runs, kept))
    return out


def shingles(text, size=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def linked(docs, percent=75):
    """Per ``(doc_id, text)``: size of its set and smallest id of its component."""
    sets = [shingles(text) for _, text in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and 100 * len(sets[i] & sets[j]) >= percent * union:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(docs)]


def top_k(vectors, k=10, scale=1024):
    """``(query, rank, id, score)`` for queries with ids divisible by 100."""
    whole = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in vectors
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for query, q in whole:
        if query % 100 == 0:
            scored = [(-sum(map(int.__mul__, q, v)), i) for i, v in whole if i != query and len(v) == len(q)]
            out += [(query, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], start=1)]
    return out
