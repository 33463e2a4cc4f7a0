"""Column-wise construction of a collection's Burrows-Wheeler transform.

Many short strings stand under each other, so that places which can match are
in the same column.  From the last column to the first, each round puts one
more symbol in front of every string: the suffixes that begin in that column
are sorted by the new symbol, and among equal ones by the order of the round
before, which is all there is to inserting them.  With the order, each round
updates the transform (the symbol before each suffix) and the common prefix of
neighbours: one more than the least common prefix between their old places.

Order and common prefixes of a round are written to one sequential file while
those of the round before are read from another, so that memory holds the
strings and a few columns.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

# Stands where a string has no symbol; never equal to another.
ABSENT = 256


class _File:
    """Two sequential files that take turns."""

    def __init__(self):
        self._old, self._new = tempfile.TemporaryFile(), tempfile.TemporaryFile()

    def write(self, *columns: np.ndarray) -> None:
        self._new.seek(0)
        for column in columns:
            self._new.write(column.data)
        self._old, self._new = self._new, self._old

    def read(self, *kinds: tuple[type, int]) -> list[np.ndarray]:
        self._old.seek(0)
        return [
            np.frombuffer(self._old.read(n * np.dtype(kind).itemsize), dtype=kind)
            for kind, n in kinds
        ]

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self._old.close()
        self._new.close()


def rounds(
    symbols: np.ndarray, most: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(column, order, transform, common)`` from the last column to the first.

    ``symbols`` has a row per string, with ``ABSENT`` where it has none.
    ``order`` are the rows by their suffixes from ``column`` on, ``transform``
    the symbols before these suffixes, and ``common[i]`` the length, up to
    ``most``, of what suffixes ``i - 1`` and ``i`` have in common.
    """
    n, width = symbols.shape
    symbols = np.asfortranarray(symbols)  # a round takes one column
    with _File() as file:
        file.write(np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.uint8))
        for column in range(width - 1, -1, -1):
            order, common = file.read((np.int32, n), (np.uint8, n))
            symbol = symbols[order, column]
            place = np.argsort(symbol, kind="stable")
            order, symbol = order[place], symbol[place]
            common = _extended(symbol, place, common, most)
            file.write(order, common)
            before = symbols[order, column - 1] if column else np.full(n, ABSENT, symbols.dtype)
            yield column, order, before, common


def _extended(symbol: np.ndarray, place: np.ndarray, common: np.ndarray, most: int) -> np.ndarray:
    out = np.zeros(len(symbol), dtype=np.uint8)
    same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != ABSENT)) + 1
    if len(same):
        ranges = np.column_stack((place[same - 1] + 1, place[same] + 1)).ravel()
        padded = np.append(common, np.uint8(0))
        least = np.minimum.reduceat(padded, ranges)[::2]
        out[same] = np.minimum(least, most - 1) + 1
    return out


def repeated(symbols: np.ndarray, owners: np.ndarray, span: int, columns: int) -> np.ndarray:
    """Where a string's ``span`` symbols also stand in one of a lesser owner.

    One row per string and one column per start, for starts below ``columns``.
    """
    out = np.zeros((len(symbols), columns), dtype=bool)
    for column, order, _, common in rounds(symbols, span):
        if column >= columns:
            continue
        first = common < span
        first[0] = True
        starts = np.flatnonzero(first)
        owner = owners[order]
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(owner))))
        out[order, column] = least < owner
    return out
