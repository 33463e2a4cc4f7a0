"""Framing, change detection and the tail source."""

from __future__ import annotations

import json
import os

import pytest

from millrace.sources.scan import advance_cursor, plan_scan, resume_lines
from millrace.sources.tail import (
    TailBatchReader,
    TailStreamReader,
    last_offset,
    read_range,
    register,
    tail_options,
)
from millrace.sources.text import frame_lines, read_lines, split_valid
from millrace.streaming.ship import read_tail

FRAMES = [
    ("a\nb\n", ["a", "b"]),
    ("a\nb", ["a", "b"]),
    ("a\r\nb\r\n", ["a", "b"]),
    ("a\r\r\n", ["a\r"]),
    ("a\rb\n", ["a\rb"]),
    ("tail\r", ["tail\r"]),
    ("\n\n", ["", ""]),
    ("\n", [""]),
    ("", []),
    ('  x  \n\ty\t\n"q"\n', ["  x  ", "\ty\t", '"q"']),
    ("é☃😀\n", ["é☃😀"]),
]


def test_frame_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FRAMES)], "id int, text string")
    rows = frame_lines(df, "text", ["id"]).orderBy("id", "line_no").collect()
    for i, (_, lines) in enumerate(FRAMES):
        assert [r["line"] for r in rows if r["id"] == i] == lines
        assert [r["line_no"] for r in rows if r["id"] == i] == list(range(len(lines)))


def test_read_lines_keeps_order_across_byte_ranges(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_bytes(b"".join(b"line %d \r x\r\n" % i for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_lines(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        got = [r["line"] for r in df.orderBy("block", "seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"line {i} \r x" for i in range(5000)]


def test_invalid_utf8_is_quarantined_not_lost(spark, tmp_path):
    path = tmp_path / "bad.log"
    path.write_bytes(b"good\nbad \xff\nfine \xc3\xa9\n")
    for lines in (read_lines(spark, str(path)), read_tail(spark, [str(path)])):
        good, bad = split_valid(lines)
        assert sorted(r["line"] for r in good.collect()) == ["fine é", "good"]
        assert bad.count() == 1


SCANS = [
    # listing, cursor, action, start, end, inode, position
    ((7, 10), None, "new", None, None, 7, 10),
    ((7, 10), (7, 4), "append", 4, 10, 7, 10),
    ((7, 10), (7, 10), "idle", None, None, 7, 10),
    ((7, 3), (7, 10), "truncated", 0, 3, 7, 3),
    ((8, 3), (7, 10), "rotated", None, None, 8, 3),
    ((8, 30), (7, 10), "rotated", None, None, 8, 30),
    (None, (7, 10), "missing", None, None, 7, 10),
]


def scan_tables(spark):
    listing = [(f"/{i}", *s[0]) for i, s in enumerate(SCANS) if s[0]]
    cursor = [(f"/{i}", *s[1]) for i, s in enumerate(SCANS) if s[1]]
    return (
        spark.createDataFrame(listing, "path string, inode long, size long"),
        spark.createDataFrame(cursor, "path string, inode long, position long"),
    )


def test_plan_scan(spark):
    rows = plan_scan(*scan_tables(spark)).orderBy("path").collect()
    assert [tuple(r) for r in rows] == [(f"/{i}", *s[2:]) for i, s in enumerate(SCANS)]


def test_plan_scan_backfill(spark):
    rows = plan_scan(*scan_tables(spark), from_start=True).orderBy("path").collect()
    ranges = {r["path"]: (r["start_pos"], r["end_pos"]) for r in rows}
    assert ranges["/0"] == (0, 10) and ranges["/4"] == (0, 3) and ranges["/6"] == (None, None)


def test_a_second_scan_finds_nothing_new(spark):
    listing, cursor = scan_tables(spark)
    again = plan_scan(listing, advance_cursor(plan_scan(listing, cursor)))
    assert {r["action"] for r in again.collect()} == {"idle", "missing"}


def test_resumed_lines_are_cut_at_bytes(spark):
    text = "é☃\nnext\nlast"
    content = spark.createDataFrame([("/a", text)], "path string, text string")
    size, first = len(text.encode()), len("é☃\n".encode())
    listing = spark.createDataFrame([("/a", 1, size)], "path string, inode long, size long")
    cursor = spark.createDataFrame([("/a", 1, first)], "path string, inode long, position long")
    rows = resume_lines(content, plan_scan(listing, cursor)).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["next", "last"]


class Poller:
    """Drives the streaming reader the way a query does."""

    def __init__(self, paths, **options):
        self.reader = TailStreamReader(tail_options(paths, **options))
        self.offset = self.reader.initialOffset()

    def poll(self) -> list[tuple[str, str]]:
        start, self.offset = self.offset, self.reader.latestOffset()
        return [
            (path, line.decode())
            for part in self.reader.partitions(start, self.offset)
            for batch in read_range(part)
            for path, line in zip(batch["path"].to_pylist(), batch["line"].to_pylist())
        ]

    def lines(self) -> list[str]:
        return [line for _, line in self.poll()]


def append(path, data: bytes) -> None:
    with open(path, "ab") as handle:
        handle.write(data)


def planned(tail) -> list:
    """Read tasks of the next poll, planned and not yet run."""
    start, tail.offset = tail.offset, tail.reader.latestOffset()
    return list(tail.reader.partitions(start, tail.offset))


@pytest.mark.parametrize("change", ["deleted", "replaced", "shortened"])
def test_a_file_that_changes_after_planning_is_reported_and_others_go_on(tmp_path, change):
    path, other = tmp_path / "a.log", tmp_path / "b.log"
    append(path, b"")
    append(other, b"")
    tail = Poller([str(path), str(other)])
    append(path, b"one\ntwo\n")
    append(other, b"fine\n")
    tasks = planned(tail)
    if change == "shortened":
        os.truncate(path, 3)
    else:
        os.rename(path, tmp_path / "a.old")
        if change == "replaced":
            append(path, b"not this one, though it is long\n")
    rows = [r for task in tasks for batch in read_range(task) for r in batch.to_pylist()]
    assert [(r["path"], r["line"], r["lost"]) for r in rows] == [
        (str(path), None, 8),
        (str(other), b"fine", None),
    ]
    append(other, b"more\n")
    assert ("more") in tail.lines()


def test_a_restart_keeps_the_cursor_of_a_file_that_is_away(tmp_path):
    path, other = tmp_path / "a.log", tmp_path / "b.log"
    append(path, b"early\n")
    append(other, b"")
    tail = Poller([str(path), str(other)])
    os.rename(path, tmp_path / "away")
    resumed = Poller.__new__(Poller)
    resumed.reader, resumed.offset = TailStreamReader(tail_options([str(path), str(other)])), tail.offset
    append(other, b"x\n")
    assert resumed.lines() == ["x"]
    os.rename(tmp_path / "away", path)
    append(path, b"late 1\nlate 2\n")
    assert resumed.lines() + resumed.lines() == ["late 1", "late 2"]


def test_a_cursor_cut_short_is_ignored_and_replaced(tmp_path):
    path, cursor = tmp_path / "a.log", tmp_path / "new" / "cursor.json"
    append(path, b"early\n")
    tail = Poller([str(path)], cursorPath=str(cursor))
    append(path, b"one\n")
    assert tail.lines() == ["one"]
    assert json.loads(cursor.read_text())[str(path)]["position"] == 10
    cursor.write_text(cursor.read_text()[:7])
    assert TailStreamReader(tail_options([str(path)], cursorPath=str(cursor))).cursor is None


def test_new_lines_only(tmp_path):
    path = tmp_path / "a.log"
    append(path, b"Line 1\nLine 2\n")
    tail = Poller([str(path)])
    assert tail.lines() == []
    append(path, b"Line 3\nLine 4\n")
    assert tail.lines() == ["Line 3", "Line 4"]
    assert tail.lines() == []


def test_empty_and_missing_files(tmp_path):
    path = tmp_path / "later.log"
    tail = Poller([str(path), str(tmp_path / "never.log")])
    assert tail.lines() == []
    append(path, b"")
    assert tail.lines() == []
    append(path, b"first\n")
    assert tail.lines() == ["first"]


def test_a_file_that_appears_later_starts_at_its_end(tmp_path):
    path = tmp_path / "later.log"
    tail = Poller([str(path)])
    append(path, b"there already\n")
    assert tail.lines() == []
    append(path, b"fresh\n")
    assert tail.lines() == ["fresh"]


def test_truncation(tmp_path):
    path = tmp_path / "a.log"
    append(path, b"Line 1\nLine 2\n")
    tail = Poller([str(path)])
    append(path, b"Line 3\n")
    assert tail.lines() == ["Line 3"]
    path.write_bytes(b"New Line 1\n")
    assert tail.lines() == ["New Line 1"]
    path.write_bytes(b"")
    assert tail.lines() == []
    append(path, b"after\n")
    assert tail.lines() == ["after"]


@pytest.mark.parametrize(("start", "first"), [("latest", []), ("earliest", ["new 1"])])
def test_rotation(tmp_path, start, first):
    path = tmp_path / "a.log"
    append(path, b"old\n")
    tail = Poller([str(path)], rotationStart=start)
    os.rename(path, tmp_path / "a.log.1")
    append(path, b"new 1\n")
    assert tail.lines() == first
    append(path, b"new 2\n")
    assert tail.lines() == ["new 2"]


def test_missing_file_keeps_its_cursor(tmp_path):
    path, away = tmp_path / "a.log", tmp_path / "away"
    append(path, b"one\n")
    tail = Poller([str(path)])
    os.rename(path, away)
    assert tail.lines() == []
    append(away, b"two\n")
    os.rename(away, path)
    assert tail.lines() == ["two"]


def test_files_are_independent(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    append(a, b"")
    append(b, b"")
    tail = Poller([str(a), str(b), str(a)])
    append(a, b"File1 Line1\n")
    append(b, b"File2 Line1\n")
    assert sorted(tail.poll()) == [(str(a), "File1 Line1"), (str(b), "File2 Line1")]


def test_partial_lines_are_emitted_or_held(tmp_path):
    path = tmp_path / "a.log"
    append(path, b"")
    emit, hold = Poller([str(path)]), Poller([str(path)], partialLines="hold")
    append(path, b"one\ntw")
    assert emit.lines() == ["one", "tw"]
    assert hold.lines() == ["one"]
    append(path, b"o\n")
    assert emit.lines() == ["o"]
    assert hold.lines() == ["two"]


@pytest.mark.parametrize("read_bytes", [1, 3, 1 << 20])
@pytest.mark.parametrize("partition_bytes", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("data", [b"a\n\nbb\nccc\r\n\nlong record here\nx", b"\n\n\n", b"abc", b"ab\r\ncd\n"])
def test_byte_ranges_neither_lose_nor_repeat_records(
    tmp_path, monkeypatch, partition_bytes, data, read_bytes
):
    monkeypatch.setattr("millrace.sources.tail.READ_BYTES", read_bytes)
    path = tmp_path / "a.log"
    append(path, data)
    tail = Poller([str(path)], startingOffsets="earliest", partitionBytes=partition_bytes)
    pieces = data.split(b"\n")
    want = [p.removesuffix(b"\r").decode() for p in pieces[:-1]] + ([pieces[-1].decode()] if pieces[-1] else [])
    assert tail.lines() == want


@pytest.mark.parametrize("limit", [1, 5, 9, 1000])
def test_byte_limit_takes_whole_records(tmp_path, limit):
    path = tmp_path / "a.log"
    want = [f"record {i}" * (i % 3 + 1) for i in range(20)]
    append(path, "".join(w + "\n" for w in want).encode())
    tail = Poller([str(path)], startingOffsets="earliest", maxBytesPerTrigger=limit)
    got, polls = [], 0
    while len(got) < len(want):
        fresh = tail.lines()
        assert fresh and (limit == 1000 or len(fresh) <= 1)
        got, polls = got + fresh, polls + 1
    assert got == want and tail.lines() == []


def test_cursor_file_survives_a_restart(tmp_path):
    path, other = tmp_path / "a.log", tmp_path / "away.log"
    append(path, b"")
    options = {"cursorPath": str(tmp_path / "cursor.json"), "maxBytesPerTrigger": 4}
    tail = Poller([str(path), str(other)], **options)
    append(other, b"x\n")
    append(path, b"one\ntwo\n")
    assert tail.lines() == ["one"]
    os.rename(other, tmp_path / "hidden")
    resumed = TailStreamReader(tail_options([str(path), str(other)], **options))
    after = resumed.latestOffset()
    assert after[str(path)]["position"] == 8
    assert after[str(other)] == tail.offset[str(other)]


def test_batch_read_has_byte_offsets(spark, tmp_path):
    path = tmp_path / "a.log"
    append(path, "é\nbb\n\nc".encode())
    rows = read_tail(spark, [str(path), str(tmp_path / "none")]).orderBy("offset").collect()
    assert [(r["offset"], r["line"]) for r in rows] == [(0, "é"), (3, "bb"), (6, ""), (7, "c")]
    assert {r["inode"] for r in rows} == {os.stat(path).st_ino}


@pytest.mark.parametrize("low", range(0, 30, 3))
@pytest.mark.parametrize("partition_bytes", [2, 1000])
def test_offset_ranges_open_their_bytes_only(tmp_path, low, partition_bytes):
    data = b"a\n\nbb\nccc\r\n\nlong record here\nx"
    path = tmp_path / "a.log"
    append(path, data)
    at = [0, *(i + 1 for i, byte in enumerate(data) if byte == 10)]
    for high in range(low, 34, 2):
        options = {"partitionBytes": partition_bytes, "fromOffset": low, "untilOffset": high}
        parts = TailBatchReader(tail_options([str(path)], **options)).partitions()
        assert all(low <= part.start < part.stop <= high for part in parts)
        found = [o for part in parts for batch in read_range(part) for o in batch["offset"].to_pylist()]
        assert found == [o for o in at if low <= o < high]


def test_frames_with_different_filters_share_nothing(spark, tmp_path):
    path = tmp_path / "a.log"
    append(path, b"".join(b"line %d\n" % i for i in range(100)))
    rows = read_tail(spark, [str(path)], partitionBytes=16)
    assert rows.filter("offset < 70").unionByName(rows.filter("offset >= 70")).count() == 100
    assert rows.filter("offset >= 70 and offset <= 84").count() == 2 and rows.count() == 100
    assert read_tail(spark, [str(path)], fromOffset=5000).count() == 0
    assert read_tail(spark, [str(tmp_path / "none")]).count() == 0


def test_the_checkpoint_gives_the_offset_planned_last(spark, tmp_path):
    path, away, work = tmp_path / "a.log", tmp_path / "away.log", tmp_path / "work"
    append(path, b"one\ntwo\nthree\n")
    append(away, b"x\n")
    checkpoint = f"file://{work}/checkpoint"
    assert last_offset(spark, checkpoint) is None
    register(spark)
    options = tail_options([str(path), str(away)], startingOffsets="earliest", maxBytesPerTrigger=4)

    def run():
        stream = spark.readStream.format("logtail").options(**options).load().writeStream
        stream = stream.format("noop").option("checkpointLocation", checkpoint).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    run()
    planned = json.loads(last_offset(spark, checkpoint))
    assert planned[str(path)]["position"] == 14 and planned[str(away)]["position"] == 2
    os.rename(away, tmp_path / "hidden")
    append(path, b"four\nfive\n")
    resumed = TailStreamReader({**options, "startCursor": json.dumps(planned)})
    after = resumed.latestOffset()
    assert after[str(path)]["position"] == 19 and after[str(away)] == planned[str(away)]
