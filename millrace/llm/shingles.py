"""Distinct word shingles of texts as 64-bit hashes.

Words are runs of anything but ASCII white space, ASCII letters in lower case.
A text of fewer words than a shingle has is one shingle; one without words has
none.  Equal shingles have equal hashes; different ones share a hash with a
chance of about 1 in 2^64, which is taken as never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.common import flat_bytes, mix

SIZE = 5
# Bytes of text worked on at once; arrays of some thirty times as many are made of them.
_STEP = 512 * 1024

_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xF1357AEA2E62A9C5)
_OF_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    factors = np.full(max(n, 1), _BASE, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words come before each text (one more)."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = ends[1:-1][ends[1:-1] < len(data)]
    begins[inner] = ~space[inner]  # a word ends with its text
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, ends)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    kept = np.flatnonzero(~space)
    word = np.cumsum(begins)[kept] - 1
    place = kept - starts[word]
    values = _OF_BYTE[_LOWER[data[kept]]] * _powers(int(place.max()) + 1)[place]
    firsts = np.flatnonzero(begins[kept])
    return mix(np.add.reduceat(values, firsts)), counts


def shingle_sets(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, ends = flat_bytes(column)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(ends, ends[row] + _STEP, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        part = ends[row : last + 1]
        yield from _sets(data[part[0] : part[-1]], part - part[0], size)
        row = last


def _sets(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    words, counts = word_hashes(data, ends)
    n = max(0, len(words) - size + 1)
    full = np.full(n, np.uint64(size))
    for place in range(size):
        full += words[place : place + n] * _OF_PLACE[place]
    full = mix(full)
    for first, last in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if last - first >= size:
            yield np.unique(full[first : last - size + 1])
        elif last > first:
            some = words[first:last] * _OF_PLACE[: last - first]
            yield mix(np.array([some.sum(dtype=np.uint64) + np.uint64(last - first)]))
        else:
            yield np.zeros(0, dtype=np.uint64)
