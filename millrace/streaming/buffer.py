"""The size-or-time buffer as a stateful streaming operator.

One state per route: the buffered lines, their number, the time of the last
flush and the number of flushes.  Every micro-batch is one poll.  All its lines
are appended before the size is tested, and a flush takes the whole buffer.

State stays bounded: after each poll a route holds fewer than ``buffer_size``
lines, and a poll adds no more than the source's ``maxBytesPerTrigger``.  The lines
of a poll are sorted in runs, which go to a temporary file if there are several, and
what is flushed leaves part by part, so that a task's memory follows the size of a run
and of a part and not that of a poll.
"""

from __future__ import annotations

import heapq
import math
import pickle
import sys
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.batching import BUFFER_FULL, MAX_PART_LINES, TIME_ELAPSED

BATCH_SCHEMA = (
    "route_id bigint, path string, batch_id bigint, part bigint, flush_at bigint, "
    "reason string, n_entries bigint, entries array<struct<path:string,line:string>>"
)
_COLUMNS = [
    "route_id",
    "path",
    "batch_id",
    "part",
    "flush_at",
    "reason",
    "n_entries",
    "entries",
]

# Lines that are sorted at once, that are read back from a run at once, runs that are
# merged to a longer one, and lines that are given to the state or passed on at once.
RUN_LINES = 65_536
READ_LINES = 1024
MOST_RUNS = 64
FRAME_LINES = 65_536

# Route of rows that are passed on and not buffered.
SET_ASIDE = -1

STATE_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


@dataclass(frozen=True)
class BufferSettings:
    path: str
    polling_frequency_ms: int
    buffer_size: int
    flush_interval_ms: int


class SortedLines:
    """The lines of a poll by offset; equal offsets stay in the order they came in."""

    def __init__(self, run_lines: int | None = None):
        self.run_lines = run_lines or RUN_LINES
        self.n = 0
        self._frames: list[pd.DataFrame] = []
        self._waiting = 0
        self._file = None
        # Places in the file by run, and runs by how often they were merged.
        self._levels: list[list[list[int]]] = []

    def add(self, frame: pd.DataFrame) -> None:
        self._frames.append(frame[["offset", "line"]])
        self._waiting += len(frame)
        self.n += len(frame)
        if self._waiting >= self.run_lines:
            self._spill()

    def __iter__(self) -> Iterator[str]:
        if not self._levels:
            return iter(self._sorted()["line"].tolist() if self._frames else [])
        if self._frames:
            self._spill()
        # What was merged most often came first.
        return (line for _, line in self._merged(chain(*reversed(self._levels))))

    def close(self) -> None:
        if self._file is not None:
            self._file.close()

    def _sorted(self) -> pd.DataFrame:
        rows = pd.concat(self._frames, ignore_index=True)
        # Lines without an offset come last.
        return rows.fillna({"offset": math.inf}).sort_values("offset", kind="stable")

    def _spill(self) -> None:
        rows = self._sorted()
        self._frames, self._waiting = [], 0
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        run, level = self._written(zip(rows["offset"].tolist(), rows["line"].tolist())), 0
        while True:
            if level == len(self._levels):
                self._levels.append([])
            runs = self._levels[level]
            runs.append(run)
            if len(runs) < MOST_RUNS:
                return
            run, level = self._written(self._merged(runs)), level + 1
            runs.clear()

    def _written(self, rows: Iterable[tuple[int, str]]) -> list[int]:
        places = []
        for piece in _pieces(rows, READ_LINES):
            places.append(self._file.seek(0, 2))
            pickle.dump(piece, self._file, pickle.HIGHEST_PROTOCOL)
        return places

    def _merged(self, runs: Iterable[list[int]]) -> Iterator[tuple[int, str]]:
        return heapq.merge(*map(self._read, runs), key=lambda row: row[0])

    def _read(self, places: list[int]) -> Iterator[tuple[int, str]]:
        for place in places:
            self._file.seek(place)
            yield from pickle.load(self._file)


def _pieces(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while piece := list(islice(rows, size)):
        yield piece


class FlushProcessor(StatefulProcessor):
    """Keyed by ``route_id``; emits one row per batch part."""

    def __init__(
        self,
        settings: dict[int, BufferSettings],
        started_ms: int,
        max_part_lines: int = MAX_PART_LINES,
    ):
        self.settings = settings
        self.started_ms = started_ms
        self.max_part_lines = max_part_lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "line string")
        self.clock = handle.getValueState(
            "clock", "n bigint, last_flush bigint, last_poll bigint, flushes bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == SET_ASIDE:
            yield from self._pass_on(rows, timerValues.getCurrentProcessingTimeInMs())
            return
        route = self.settings[key[0]]
        n, last_flush, last_poll, flushes = self._load()
        fresh = SortedLines()
        try:
            for frame in rows:
                fresh.add(frame)
            yield from self._take_in(
                key[0], route, fresh, (n + fresh.n, last_flush, last_poll, flushes), timerValues
            )
        finally:
            fresh.close()

    def _take_in(
        self,
        route_id: int,
        route: BufferSettings,
        fresh: SortedLines,
        clock: tuple[int, int, int, int],
        timerValues,
    ) -> Iterator[pd.DataFrame]:
        n, last_flush, last_poll, flushes = clock
        now = timerValues.getCurrentProcessingTimeInMs()
        if self._poll_number(route, now) > self._poll_number(route, last_poll):
            last_poll = now
            reason = _reason(route, n, now - last_flush)
            if reason is not None:
                yield from self._flush(route_id, fresh, now, reason, flushes)
                return
        for piece in _pieces(fresh, FRAME_LINES):
            self.buffer.appendList([(line,) for line in piece])
        self._wait(route, n, last_flush, last_poll, flushes)

    def _pass_on(self, rows, now: int) -> Iterator[pd.DataFrame]:
        """What is set aside waits for nothing."""
        for frame in rows:
            entries = frame[["path", "line"]].to_dict("records")
            row = (SET_ASIDE, None, 0, 0, now, "set aside", len(entries), entries)
            yield pd.DataFrame([row], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        route = self.settings[key[0]]
        n, last_flush, _, flushes = self._load()
        if n == 0:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        reason = _reason(route, n, now - last_flush)
        if reason is not None:
            yield from self._flush(key[0], [], now, reason, flushes)
        else:
            self._wait(route, n, last_flush, now, flushes)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[int, int, int, int]:
        if self.clock.exists():
            return self.clock.get()
        return 0, self.started_ms, self.started_ms, 0

    def _poll_number(self, route: BufferSettings, at_ms: int) -> int:
        return (at_ms - self.started_ms) // route.polling_frequency_ms

    def _wait(
        self, route: BufferSettings, n: int, last_flush: int, last_poll: int, flushes: int
    ) -> None:
        """Keep the buffer and come back at the next poll that could flush it."""
        self.clock.update((n, last_flush, last_poll, flushes))
        poll = self._poll_number(route, last_poll) + 1
        if n < route.buffer_size:
            expires = last_flush + route.flush_interval_ms - self.started_ms
            poll = max(poll, -(-expires // route.polling_frequency_ms))
        self._clear_timers()
        self.handle.registerTimer(self.started_ms + poll * route.polling_frequency_ms)

    def _clear_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _flush(
        self, route_id: int, fresh: Iterable[str], now: int, reason: str, flushes: int
    ) -> Iterator[pd.DataFrame]:
        buffered = (row[0] for row in self.buffer.get()) if self.buffer.exists() else ()
        path = self.settings[route_id].path
        rows, held = [], 0
        for part, piece in enumerate(_pieces(chain(buffered, fresh), self.max_part_lines)):
            entries = [{"path": path, "line": line} for line in piece]
            rows.append(
                (route_id, path, flushes + 1, part, now, reason, len(piece), entries)
            )
            held += len(piece)
            if held >= FRAME_LINES:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)
        self.buffer.clear()
        self.clock.update((0, now, now, flushes + 1))
        self._clear_timers()


def _reason(route: BufferSettings, n: int, since_flush_ms: int) -> str | None:
    """Why a non-empty buffer is flushed at this poll; the size comes first."""
    if n >= route.buffer_size:
        return BUFFER_FULL
    return TIME_ELAPSED if since_flush_ms >= route.flush_interval_ms else None


def buffer_stream(
    routed: DataFrame,
    settings: dict[int, BufferSettings],
    started_ms: int,
    max_part_lines: int = MAX_PART_LINES,
) -> DataFrame:
    """Batch a stream of routed lines ``(route_id, offset, line)``.

    With a ``path``, rows of route ``SET_ASIDE`` come out as they come in.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    path = F.col("path") if "path" in routed.columns else F.lit(None).cast("string")
    return (
        routed.select("route_id", path.alias("path"), "offset", "line")
        .groupBy("route_id")
        .transformWithStateInPandas(
            FlushProcessor(settings, started_ms, max_part_lines),
            outputStructType=BATCH_SCHEMA,
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )
