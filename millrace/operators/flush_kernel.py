"""Flush positions of one stretch of poll ticks.

Ticks are counted in poll periods.  With ``last`` the previous flush, the next
flush is the earliest tick at which the lines since ``last`` reach
``buffer_size``, or, if that comes first, the earliest tick at least
``interval`` ticks after ``last`` by which any line has arrived.  A flush leaves
an empty buffer behind, so where the chain continues depends on ``last`` alone.

That makes long histories divisible.  A chunk of ticks can be summarised
without knowing what came before it: ``last`` is one of the ``interval`` ticks
before the chunk, or it is older, in which case the buffer is empty and the
first line flushes at its own tick.  :func:`summarise` records where each of
these entries leaves the chunk.  A summary is a map from entries to entries of
the next chunk, so neighbours compose to the map of both (:func:`compose`);
:func:`follow` goes along a few maps from a known entry, and :func:`flushes`
replays a chunk from its one true entry.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

# Chunks with at least one line in so many polls are summarised with arrays.
DENSE_SHARE = 16


@dataclass(frozen=True)
class Chunk:
    """Ticks ``first..final`` of a route, after those of the look-back stretch."""

    ticks: Sequence[int]  # non-empty ticks in order, look-back ones included
    counts: Sequence[int]  # lines per tick
    first: int
    final: int
    buffer_size: int
    interval: int  # in ticks, at least 1

    @property
    def idle(self) -> int:
        """Entry that stands for every flush older than the look-back stretch."""
        return self.first - self.interval - 1


def flushes(chunk: Chunk, last: int) -> Iterator[tuple[int, int, int, bool]]:
    """Flushes inside the chunk after one at ``last``.

    Yields ``(tick, begin, end, full)``; ``begin`` and ``end`` delimit the
    positions in ``chunk.ticks`` whose lines it carries.
    """
    ticks, running = chunk.ticks, list(accumulate(chunk.counts))
    step = _stepper(chunk, running)
    begin = bisect_left(ticks, chunk.first) if last <= chunk.idle else bisect_right(ticks, last)
    while True:
        found = step(last, begin)
        if found is None:
            return
        last, end, full = found
        yield last, begin, end, full
        begin = end


def _stepper(chunk: Chunk, running: list[int]):
    ticks, size, final = chunk.ticks, chunk.buffer_size, chunk.final
    interval, n_ticks = chunk.interval, len(chunk.ticks)

    def step(last: int, begin: int) -> tuple[int, int, bool] | None:
        if begin >= n_ticks:
            return None
        before = running[begin - 1] if begin else 0
        by_time = max(last + interval, ticks[begin])
        filled = bisect_left(running, before + size, begin)
        if filled < n_ticks and ticks[filled] <= by_time:
            at, end, full = ticks[filled], filled + 1, True
        else:
            at, end, full = by_time, bisect_right(ticks, by_time, begin), False
        return None if at > final else (at, end, full)

    return step


# Entries ``low..high`` leave the chunk after ``n_flushes`` flushes at tick
# ``leave``, or each ``leave`` ticks after itself where ``shift`` is set.
Run = tuple[int, int, int, int, bool]


def summarise(chunk: Chunk) -> list[Run]:
    """Where every possible entry leaves the chunk.

    Returns runs ``(low, high, leave, n_flushes, shift)`` over the entries; what
    they leave at is an entry of the following chunk.  The work follows the
    non-empty ticks, however long the interval is.
    """
    if len(chunk.ticks) * DENSE_SHARE >= chunk.final - chunk.idle:
        leaves = _leaves_by_array(chunk)
        found = [
            (entry, entry, leave, n, False)
            for entry, (leave, n) in zip(range(chunk.idle, chunk.first), leaves)
        ]
    else:
        found = sorted(_Segments(chunk).runs())
    return _merged(found)


def _merged(found: Iterable[Run]) -> list[Run]:
    """Neighbouring runs with the same outcome as one."""
    runs: list[Run] = []
    for run in found:
        if runs and runs[-1][2:] == run[2:]:
            runs[-1] = (runs[-1][0], *run[1:])
        else:
            runs.append(run)
    return runs


class _Segments:
    """Entries between two non-empty ticks have the same next line.

    They flush together: at that line's tick, at the tick that fills the
    buffer, or each an interval after itself.  So a stretch of entries is
    followed as one, and cut only where it meets a tick.
    """

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.running = list(accumulate(chunk.counts))
        self.next_idle = chunk.final - chunk.interval
        self.known: dict[int, tuple[int, int]] = {}

    def runs(self) -> Iterator[Run]:
        chunk = self.chunk
        begin = bisect_left(chunk.ticks, chunk.first)
        flush = self._flush_of(begin, chunk.idle, chunk.idle)
        yield from self._resolved(chunk.idle, chunk.idle, 0, 0, flush)
        # Stretches of entries, how far they have moved, and their flushes.
        open_: list[tuple[int, int, int, int]] = []
        if chunk.idle + 1 < chunk.first:
            open_.append((chunk.idle + 1, chunk.first - 1, 0, 0))
        while open_:
            low, high, moved, n = open_.pop()
            for a, b, flush in self._pieces(low + moved, high + moved):
                part = (a - moved, b - moved)
                if flush == "later":
                    open_.append((*part, moved + chunk.interval, n + 1))
                else:
                    yield from self._resolved(*part, moved, n, flush)

    def _pieces(self, low: int, high: int) -> Iterator[tuple[int, int, int | str | None]]:
        """``low..high`` by what comes next: a tick, ``"later"``, or None."""
        ticks = self.chunk.ticks
        while low <= high:
            begin = bisect_right(ticks, low)
            top = min(high, ticks[begin] - 1) if begin < len(ticks) else high
            yield from self._split(begin, low, top)
            low = top + 1

    def _split(self, begin: int, low: int, high: int):
        chunk = self.chunk
        if begin >= len(chunk.ticks):
            yield low, high, None
            return
        line, filled = chunk.ticks[begin], self._filled(begin)
        # Up to here the interval is over when the line comes.
        at_line = min(high, line - chunk.interval)
        if low <= at_line:
            yield low, at_line, line
        low = max(low, at_line + 1)
        # From here on the buffer fills before the interval is over.
        by_size = high + 1 if filled is None else max(low, min(high + 1, filled - chunk.interval))
        inside = min(by_size - 1, chunk.final - chunk.interval)
        if low <= inside:
            yield low, inside, "later"
        if max(low, inside + 1) < by_size:
            yield max(low, inside + 1), by_size - 1, None
        if by_size <= high:
            yield by_size, high, filled

    def _filled(self, begin: int) -> int | None:
        before = self.running[begin - 1] if begin else 0
        at = bisect_left(self.running, before + self.chunk.buffer_size, begin)
        return self.chunk.ticks[at] if at < len(self.chunk.ticks) else None

    def _flush_of(self, begin: int, low: int, high: int) -> int | str | None:
        (piece,) = self._split(begin, low, high)
        return piece[2]

    def _resolved(self, low: int, high: int, moved: int, n: int, flush) -> Iterator[Run]:
        if flush == "later":
            flush = low + moved + self.chunk.interval
        if flush is not None:
            leave, more = self._from_tick(flush)
            yield low, high, leave, n + 1 + more, False
            return
        # Nothing flushes any more; what lies far back counts as idle.
        bound = self.next_idle - moved
        if low <= bound:
            yield low, min(high, bound), self.next_idle, n, False
        if high > bound:
            yield max(low, bound + 1), high, moved, n, True

    def _from_tick(self, last: int) -> tuple[int, int]:
        """Where a flush at one tick leads; chains that meet are followed once."""
        trail = []
        while last not in self.known:
            flush = self._flush_of(bisect_right(self.chunk.ticks, last), last, last)
            if flush is None:
                self.known[last] = (max(last, self.next_idle), 0)
                break
            trail.append(last)
            last = last + self.chunk.interval if flush == "later" else flush
        leave, n = self.known[last]
        for passed in reversed(trail):
            n += 1
            self.known[passed] = (leave, n)
        return leave, n


def _leaves_by_array(chunk: Chunk) -> Iterator[tuple[int, int]]:
    """The same by pointer doubling over every position of the chunk."""
    ticks = np.asarray(chunk.ticks, dtype=np.int64)
    running = np.cumsum(np.asarray(chunk.counts, dtype=np.int64))
    low, never = chunk.idle, chunk.final + 1
    ticks_or_never = np.append(ticks, never)
    before_of = np.concatenate(([0], running))
    last = np.arange(low, never)  # position 0 stands for the idle entry
    begin = np.searchsorted(ticks, last, side="right")
    begin[0] = np.searchsorted(ticks, chunk.first)
    by_time = np.maximum(last + chunk.interval, ticks_or_never[begin])
    filled = np.searchsorted(running, before_of[begin] + chunk.buffer_size)
    by_size = ticks_or_never[np.maximum(filled, begin)]
    following = np.minimum(by_time, by_size)
    ends = (begin >= len(ticks)) | (following > chunk.final)
    jump = np.where(ends, np.arange(len(last)), following - low)
    n_flushes = np.where(ends, 0, 1)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        n_flushes = n_flushes + n_flushes[jump]
        jump = further
    entries = chunk.first - chunk.idle
    leave = np.maximum(last[jump[:entries]], chunk.final - chunk.interval)
    return zip(leave.tolist(), n_flushes[:entries].tolist())


@dataclass(frozen=True)
class Map:
    """Where entries of a stretch leave it; ``idle`` stands for all older ones."""

    idle: int
    runs: Sequence[Run]

    def __post_init__(self):
        object.__setattr__(self, "_lows", [run[0] for run in self.runs])

    def at(self, entry: int) -> int:
        """Position of the run that an entry belongs to."""
        return bisect_right(self._lows, max(entry, self.idle)) - 1

    def __call__(self, entry: int) -> tuple[int, int]:
        """Where an entry leaves, and the flushes until then."""
        entry = max(entry, self.idle)
        _, _, leave, n_flushes, shift = self.runs[self.at(entry)]
        return (entry + leave if shift else leave), n_flushes


def compose(first: Map, second: Map) -> Map:
    """The map of two stretches that follow each other."""
    return Map(first.idle, _merged(_composed(first, second)))


def _composed(first: Map, second: Map) -> Iterator[Run]:
    for low, high, leave, n, shift in first.runs:
        if not shift:
            leave, more = second(leave)
            yield low, high, leave, n + more, False
            continue
        # Entries that leave side by side are cut where the second map changes.
        while low <= high:
            run_low, run_high, further, more, moves = second.runs[second.at(low + leave)]
            top = min(high, max(run_high, second.idle) - leave)
            if moves and low + leave < second.idle:
                # Whatever is older leaves like the idle entry.
                top = min(high, second.idle - leave)
                yield low, top, second.idle + further, n + more, False
            elif moves:
                yield low, top, leave + further, n + more, True
            else:
                yield low, top, further, n + more, False
            low = top + 1


def follow(maps: Iterable[tuple[int, Map]], entry: int, done: int) -> Iterator[tuple[int, int, int]]:
    """Go through numbered maps in order; yields ``(number, entry, flushes_before)``."""
    for number, one in maps:
        entry = max(entry, one.idle)
        yield number, entry, done
        entry, more = one(entry)
        done += more
