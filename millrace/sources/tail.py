"""Structured Streaming and batch source for growing text files.

``spark.readStream.format("logtail").option("paths", json_list)`` follows
append-only files.  Offsets are ``{path: {inode, position}}`` and live in the
query's checkpoint, so a restarted query resumes where it stopped; a new
checkpoint starts at the end of every file.

Options
    paths               JSON list of files; local paths or URIs that every
                        executor can open
    startingOffsets     ``latest`` (default) or ``earliest``
    rotationStart       where a rotated file starts: ``latest`` (default) or
                        ``earliest``
    partialLines        ``emit`` (default) an unterminated tail, or ``hold`` it
                        back until its line feed arrives
    maxBytesPerTrigger  bytes taken from one file per micro-batch; 0 = no limit
    partitionBytes      bytes per read task, default 64 MiB
    heartbeat           ``true`` makes every poll a micro-batch, even without
                        new lines, so that time triggers run
    startCursor         the offset planned last, as JSON, so that the byte limit
                        and the cursors of missing files also hold for the first
                        micro-batch after a restart; see ``last_offset``
    cursorPath          a file that remembers it instead, where no checkpoint
                        can be read
    fromOffset, untilOffset
                        a batch read opens only the byte ranges that hold the
                        records that start in ``[fromOffset, untilOffset)``.  (Spark
                        can push filters into such a source, but 4.1 keeps those of one
                        plan for the other plans of a frame, which loses rows.)

Rows are ``(path, inode, offset, arrival, line, lost)``.  Each task reads one
byte range.  If the file is gone, unreadable or another one by then, a row without
a line says so: ``lost`` bytes from ``offset`` on were not read, and the other
files go on.  A range owns the records that start in it, so it skips the record that
runs in from its left and reads past its right edge to the end of its last one.
Lines are returned with the bytes they have; separate invalid UTF-8 with
``split_valid``.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

SOURCE_NAME = "logtail"
TAIL_SCHEMA = (
    "path string, inode bigint, offset bigint, arrival timestamp_ntz, line binary, lost bigint"
)

DEFAULT_PARTITION_BYTES = 64 * 1024 * 1024
READ_BYTES = 1024 * 1024
LINE_FEED, CARRIAGE_RETURN = 10, 13

# Offset entry that moves with every poll when a heartbeat is wanted.
_HEARTBEAT = ""

_ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("inode", pa.int64()),
        ("offset", pa.int64()),
        ("arrival", pa.timestamp("us")),
        ("line", pa.binary()),
        ("lost", pa.int64()),
    ]
)


def register(spark: SparkSession) -> None:
    """Make the ``logtail`` format known to the session.

    The workers that plan and read streams do not see what was sent to the
    executors with the application, so the source travels as code.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LogTailSource)


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The offset that a stream with one source planned last, from its checkpoint.

    The checkpoint may be on any file system that Spark can use.
    """
    # Only the driver gets here; the workers that get this module by value have no package.
    from millrace.session import folder_names

    numbers = [int(name) for name in folder_names(spark, f"{checkpoint}/offsets") if name.isdigit()]
    if not numbers:
        return None
    log = spark.read.text(f"{checkpoint}/offsets/{max(numbers)}", wholetext=True).first()
    # Fixed format of the log: version, metadata, an offset per source.
    lines = log[0].split("\n") if log else []
    return lines[2] if len(lines) > 2 and lines[0] == "v1" and lines[2].startswith("{") else None


def tail_options(paths: Sequence[str], **options) -> dict[str, str]:
    """Options for ``readStream.options(**…)``."""
    return {"paths": json.dumps(list(paths)), **{k: str(v) for k, v in options.items()}}


@dataclass
class ByteRange(InputPartition):
    """Records of ``path`` that start in ``[start, stop)``; none ends after ``limit``."""

    path: str
    inode: int
    start: int
    stop: int
    limit: int
    first: bool  # whether a record starts exactly at ``start``
    arrival_us: int


class LogTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema) -> TailStreamReader:
        return TailStreamReader(self.options)

    def reader(self, schema) -> TailBatchReader:
        return TailBatchReader(self.options)


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def stat_file(path: str) -> tuple[int, int] | None:
    """``(inode, size)``, or ``None`` for a path that is not there.

    File systems without inodes report 0; rotation then shows as truncation.
    """
    filesystem, local = open_filesystem(path)
    info = filesystem.get_file_info(local)
    if info.type != pafs.FileType.File:
        return None
    if isinstance(filesystem, pafs.LocalFileSystem):
        try:
            stat = os.stat(local)
        except FileNotFoundError:
            return None
        return stat.st_ino, stat.st_size
    return 0, info.size


def complete_size(path: str, low: int, high: int) -> int:
    """End of the last terminated record of ``[low, high)``, else ``low``."""
    filesystem, local = open_filesystem(path)
    with filesystem.open_input_file(local) as handle:
        while high > low:
            begin = max(low, high - READ_BYTES)
            handle.seek(begin)
            cut = handle.read(high - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            high = begin
    return low


def byte_ranges(
    path: str, inode: int, start: int, end: int, partition_bytes: int, arrival_us: int
) -> list[ByteRange]:
    """Cut ``[start, end)``, where records begin and end, into read tasks."""
    return [
        ByteRange(
            path, inode, at, min(at + partition_bytes, end), end, at == start, arrival_us
        )
        for at in range(start, end, partition_bytes)
    ]


def clipped(parts: Sequence[ByteRange], low: int, high: int) -> list[ByteRange]:
    """What of the ranges holds the records that start in ``[low, high)``."""
    out = []
    for part in parts:
        start, stop = max(part.start, low), min(part.stop, high)
        if start < stop:
            out.append(replace(part, start=start, stop=stop, first=part.first and start == part.start))
    return out


def stat_files(paths: Sequence[str]) -> list[tuple[int, int] | None]:
    """:func:`stat_file` of many paths at once."""
    with ThreadPoolExecutor(max_workers=min(32, max(1, len(paths)))) as pool:
        return list(pool.map(stat_file, paths))


def _open_planned(part: ByteRange):
    """The file as it was planned; another or a shorter one is an error."""
    filesystem, local = open_filesystem(part.path)
    if not isinstance(filesystem, pafs.LocalFileSystem):
        if filesystem.get_file_info(local).size < part.limit:
            raise FileNotFoundError(part.path)
        return filesystem.open_input_file(local)
    handle = open(local, "rb")
    stat = os.fstat(handle.fileno())
    if stat.st_ino != part.inode or stat.st_size < part.limit:
        handle.close()
        raise FileNotFoundError(part.path)
    return handle


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """Records of one byte range, or what of it could not be read."""
    reached = [part.start]
    try:
        yield from _records(part, reached)
    except OSError:
        at = reached[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part.path]),
                pa.array([part.inode], pa.int64()),
                pa.array([at], pa.int64()),
                pa.array([part.arrival_us], pa.int64()).cast(pa.timestamp("us")),
                pa.nulls(1, pa.binary()),
                pa.array([part.stop - at], pa.int64()),
            ],
            schema=_ARROW_SCHEMA,
        )


def _records(part: ByteRange, reached: list[int]) -> Iterator[pa.RecordBatch]:
    """Arrow batches, framed a block at a time; ``reached`` follows them."""
    with _open_planned(part) as handle:
        # One byte earlier tells whether a record starts right at the edge.
        position = read_at = part.start if part.first else part.start - 1
        handle.seek(position)
        skipping = not part.first
        tail: list[bytes] = []  # blocks of the record not yet ended
        while position < part.stop:
            block = handle.read(min(READ_BYTES, part.limit - read_at))
            read_at += len(block)
            cut = block.rfind(b"\n") + 1
            if not block:
                rest = b"".join(tail)
                if rest and not skipping:
                    yield _to_batch(part, np.array([position]), np.array([0, len(rest)]), rest)
                return
            if not cut:
                tail.append(block)
                continue
            records = b"".join([*tail, block[:cut]])
            tail = [block[cut:]]
            yield from _frame(part, records, position, skipping)
            position, skipping = position + len(records), False
            reached[0] = min(position, part.stop)


def _frame(
    part: ByteRange, records: bytes, position: int, skip_first: bool
) -> Iterator[pa.RecordBatch]:
    """Terminated records that start before the range stops, without terminators."""
    data = np.frombuffer(records, dtype=np.uint8)
    ends = np.flatnonzero(data == LINE_FEED)
    starts = np.concatenate(([0], ends[:-1] + 1))
    mine = slice(int(skip_first), int(np.searchsorted(starts, part.stop - position)))
    starts, ends = starts[mine], ends[mine]
    if not len(starts):
        return
    after_cr = (ends > starts) & (data[ends - 1] == CARRIAGE_RETURN)
    wanted = np.zeros(len(data), dtype=bool)
    wanted[starts[0] : ends[-1]] = True
    wanted[ends] = False
    wanted[ends[after_cr] - 1] = False
    bounds = np.concatenate(([0], np.cumsum(ends - starts - after_cr)))
    yield _to_batch(part, position + starts, bounds, data[wanted])


def _to_batch(part: ByteRange, offsets, bounds, values) -> pa.RecordBatch:
    """Rows of lines that lie back to back in ``values``."""
    n = len(offsets)
    lines = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(values)]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(part.path), n),
            pa.repeat(pa.scalar(part.inode, pa.int64()), n),
            pa.array(offsets.astype(np.int64)),
            pa.repeat(pa.scalar(part.arrival_us, pa.int64()), n).cast(pa.timestamp("us")),
            lines,
            pa.nulls(n, pa.int64()),
        ],
        schema=_ARROW_SCHEMA,
    )


class TailBatchReader(DataSourceReader):
    """Whole files, once, with byte offsets."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.partition_bytes = int(options.get("partitionBytes", DEFAULT_PARTITION_BYTES))
        # Where the wanted records start.
        self.low = int(options.get("fromOffset", 0))
        self.high = int(options.get("untilOffset", sys.maxsize))

    def partitions(self) -> Sequence[ByteRange]:
        now = time.time_ns() // 1000
        paths = list(dict.fromkeys(self.paths))
        found = zip(paths, stat_files(paths))
        parts = [
            part
            for path, stat in found
            if stat is not None
            for part in byte_ranges(path, stat[0], 0, stat[1], self.partition_bytes, now)
        ]
        return clipped(parts, self.low, self.high)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        # Without any range, Spark reads one partition that is none.
        return iter(()) if partition is None else read_range(partition)


class TailStreamReader(DataSourceStreamReader):
    """Incremental scan of a fixed list of files."""

    def __init__(self, options: dict):
        self.paths = list(dict.fromkeys(json.loads(options["paths"])))
        self.from_start = _choice(options, "startingOffsets", "latest", "earliest")
        self.rotated_from_start = _choice(options, "rotationStart", "latest", "earliest")
        self.hold_partial = _choice(options, "partialLines", "emit", "hold")
        self.max_bytes = int(options.get("maxBytesPerTrigger", 0))
        self.partition_bytes = int(options.get("partitionBytes", DEFAULT_PARTITION_BYTES))
        self.heartbeat = str(options.get("heartbeat", "false")).lower() == "true"
        self.cursor_path = options.get("cursorPath")
        self.cursor: dict[str, dict] | None = self._load_cursor()
        if "startCursor" in options:
            self.cursor = json.loads(options["startCursor"])
            self.cursor.pop(_HEARTBEAT, None)
        self.unnamed: set[str] = set()  # known, but not in the last offset

    def initialOffset(self) -> dict:
        """Files present now start at their end, or at 0 for a backfill.

        A file that shows up later is new at that poll.
        """
        self.cursor = {}
        for path, stat in zip(self.paths, stat_files(self.paths)):
            if stat is not None:
                position = 0 if self.from_start else self._end_of(path, stat[1])
                self.cursor[path] = {"inode": stat[0], "position": position}
        return self._stamped(self.cursor)

    def latestOffset(self) -> dict:
        planned = {}
        for path, stat in zip(self.paths, stat_files(self.paths)):
            seen = (self.cursor or {}).get(path)
            if stat is None:
                if seen is not None:
                    planned[path] = seen  # keep the cursor of a missing path
                continue
            if path in self.unnamed:
                planned[path] = seen
                continue
            planned[path] = {"inode": stat[0], "position": self._advance(path, seen, *stat)}
        self.unnamed = set()
        if planned != self.cursor:
            self.cursor = planned
            self._save_cursor()
        return self._stamped(planned)

    def _stamped(self, offsets: dict) -> dict:
        if not self.heartbeat:
            return offsets
        return {**offsets, _HEARTBEAT: {"inode": 0, "position": time.time_ns() // 1000}}

    def _end_of(self, path: str, size: int) -> int:
        return complete_size(path, 0, size) if self.hold_partial else size

    def _advance(self, path: str, seen: dict | None, inode: int, size: int) -> int:
        """Position after the next micro-batch."""
        if self.cursor is None or (seen is None and not self.from_start):
            # First poll after a restart without cursorPath, or a new file.
            return self._end_of(path, size)
        rotated = seen is not None and seen["inode"] != inode
        if rotated and not self.rotated_from_start:
            return self._end_of(path, size)
        restart = seen is None or rotated or size < seen["position"]
        low = 0 if restart else seen["position"]
        high = min(size, low + self.max_bytes) if self.max_bytes else size
        if high == low or (high == size and not self.hold_partial):
            return high
        # A record is never cut: stop after the last complete one, or take the
        # whole of a record that is longer than the limit.
        cut = complete_size(path, low, high)
        if cut == low and high < size:
            return _record_end(path, high, size, self.hold_partial) or low
        return cut

    def partitions(self, start: dict, end: dict) -> Sequence[ByteRange]:
        start, end = (
            {path: seen for path, seen in offsets.items() if path != _HEARTBEAT}
            for offsets in (start, end)
        )
        # A path that is away keeps the cursor it had before a restart; the next
        # offset names it again before the path goes on.
        before = {**(self.cursor or {}), **start}
        self.unnamed = {path for path in before if path not in end}
        self.cursor = {**before, **end}
        now = time.time_ns() // 1000
        return [
            part
            for path, target in end.items()
            for part in self._ranges(path, before.get(path), target, now)
        ]

    def _ranges(self, path: str, seen: dict | None, target: dict, now: int) -> list[ByteRange]:
        inode, stop = target["inode"], target["position"]
        if seen is None:
            low = 0 if self.from_start else stop
        elif seen["inode"] != inode:
            low = 0 if self.rotated_from_start else stop
        elif stop < seen["position"]:
            low = 0
        else:
            low = seen["position"]
        return byte_ranges(path, inode, low, stop, self.partition_bytes, now)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass

    def _load_cursor(self) -> dict | None:
        if not self.cursor_path:
            return None
        filesystem, local = open_filesystem(self.cursor_path)
        if filesystem.get_file_info(local).type != pafs.FileType.File:
            return None
        try:
            with filesystem.open_input_stream(local) as handle:
                return json.loads(handle.read())
        except ValueError:  # cut short by an earlier end: as if there were none
            return None

    def _save_cursor(self) -> None:
        if self.cursor_path:
            filesystem, local = open_filesystem(self.cursor_path)
            filesystem.create_dir(os.path.dirname(local), recursive=True)
            aside = f"{local}.{uuid.uuid4().hex}"
            with filesystem.open_output_stream(aside) as handle:
                handle.write(json.dumps(self.cursor).encode())
            filesystem.move(aside, local)


def _record_end(path: str, low: int, size: int, terminated_only: bool) -> int | None:
    """End of the record that runs across ``low``."""
    filesystem, local = open_filesystem(path)
    with filesystem.open_input_file(local) as handle:
        handle.seek(low)
        at = low
        while at < size:
            block = handle.read(min(READ_BYTES, size - at))
            cut = block.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(block)
            if not block:
                break
    return None if terminated_only else size


def _choice(options: dict, key: str, default: str, other: str) -> bool:
    """Whether the option is set to its non-default value."""
    value = options.get(key, default)
    if value not in (default, other):
        raise ValueError(f"{key} must be '{default}' or '{other}', not '{value}'")
    return value == other
