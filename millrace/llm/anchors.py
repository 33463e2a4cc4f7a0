"""Anchors: places that equal stretches of two texts have in common.

Every stretch of ``span`` bytes (a window) has one anchor, the ``GRAM`` bytes
in it with the least hash, the first of several.  The anchor depends on the
window's bytes alone, so that equal windows have equal anchors at equal places,
and a text has far fewer anchors than windows.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.common import mix

GRAM = 20

_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = np.array([0xD1342543DE82EF95], dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    level, width, factor = _OF_BYTE[data], 1, _FACTOR
    out, done = None, 0
    while True:
        if gram & width:
            part = level[done : done + n]
            out = part.copy() if out is None else out * factor + part
            done += width
        if 2 * width > gram:
            return mix(out)
        level = level[:-width] * factor + level[width:]
        width, factor = 2 * width, factor * factor


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(hash, place, first, last)`` of the anchors of a text, in order.

    ``first`` to ``last`` are the starts of the windows with that anchor.
    """
    width = span - gram + 1
    hashes = gram_hashes(data, gram)
    if len(hashes) < width:
        none = np.zeros(0, dtype=np.int64)
        return hashes[:0], none, none, none
    least = sliding_least(hashes, width)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.concatenate((first[1:], [len(least)])) - 1
    long = last - first >= 2 * width
    pieces = [_short_runs(hashes, least, first[~long], last[~long], width)]
    for a, b in zip(first[long].tolist(), last[long].tolist()):
        place = a + np.flatnonzero(hashes[a : b + width] == least[a])
        begin = np.concatenate(([a], place[:-1] + 1))
        some = begin <= b
        pieces.append((place[some], begin[some], np.minimum(place, b)[some]))
    place, first, last = (np.concatenate(column) for column in zip(*pieces))
    if long.any():
        order = np.argsort(first, kind="stable")
        place, first, last = place[order], first[order], last[order]
    return hashes[place], place, first, last


def _short_runs(hashes, least, first, last, width):
    """Windows with one least value, cut where its first place drops out."""
    places, firsts, lasts = [], [], []
    reach = np.arange(width)
    while len(first):
        # Only places of the window at hand can hold its least value.
        found = hashes[first[:, None] + reach] == least[first][:, None]
        place = first + found.argmax(axis=1)
        places.append(place)
        firsts.append(first)
        lasts.append(np.minimum(place, last))
        more = place < last
        first, last = place[more] + 1, last[more]
    if not places:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    place, first, last = (np.concatenate(x) for x in (places, firsts, lasts))
    order = np.argsort(first, kind="stable")
    return place[order], first[order], last[order]
