from __future__ import annotations

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from millrace.plans.routes import normalize_routes, routes_table
from millrace.streaming import ship
from millrace.streaming.ship import (
    destination_group,
    group_folder,
    start_isolated,
    start_shipping,
)
from millrace.streaming.table_buffer import TableBuffer
from test_flush_fold import GOLDEN

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLE_CASES = ["seven lines", "burst", "idle then two", "every poll"]


def wait_for(condition, query, seconds=90):
    deadline = time.time() + seconds
    while time.time() < deadline:
        if query.exception() is not None:
            raise query.exception()
        if condition():
            return True
        time.sleep(0.1)
    return False


def recording(folder: str):
    """A transport that appends each request to a file of its route."""

    def record(request, payload):
        row = json.dumps([request["batch_id"], request["part"], json.loads(payload)])
        with open(f"{folder}/{request['route_id']}", "a") as handle:
            handle.write(row + "\n")
        return 200, ""

    return record


def batches_of(folder, route_id: int) -> list[list[str]]:
    try:
        with open(f"{folder}/{route_id}") as handle:
            rows = sorted(json.loads(x) for x in handle.read().splitlines())
    except FileNotFoundError:
        return []
    return [[e["line"] for e in entries] for _, _, entries in rows]


@pytest.mark.parametrize("buffer", ["table", "state"])
def test_end_to_end(spark, tmp_path, buffer):
    log, out = tmp_path / "app.log", str(tmp_path / "out")
    log.write_text("before the start\n")
    received = tmp_path / "received"
    received.mkdir()

    def received_lines(route_id):
        return [line for batch in batches_of(received, route_id) for line in batch]

    http = {"type": "http", "endpoint": "http://e"}
    rows = [
        {"path": str(log), "buffer_size": 3, "flush_interval_ms": 600_000, "destination": http},
        {"path": str(log), "buffer_size": 1000, "flush_interval_ms": 1500, "match_on": ["ERROR"],
         "destination": http},
        {"path": str(log), "buffer_size": 1, "destination": {"type": "file", "path": out}},
        {"path": str(log), "destination": {"type": "http"}},
    ]
    routes = normalize_routes(
        routes_table(spark, [{"route_id": i, "polling_frequency_ms": 300, **r} for i, r in enumerate(rows)])
    )
    work = str(tmp_path / "work")

    def start():
        return start_shipping(spark, routes, work, recording(str(received)), buffer=buffer)

    def file_lines():
        return [r["line"] for r in spark.read.schema("path string, line string").json(out).collect()]

    first = ["ERROR 1", "INFO 2", "ERROR 3", "INFO 4"]
    query = start()
    try:
        assert wait_for(lambda: query.lastProgress is not None, query)
        with open(log, "ab") as handle:
            handle.write("".join(x + "\n" for x in first).encode() + b"bad \xff\n")
        assert wait_for(lambda: received_lines(0) == first, query), batches_of(received, 0)
        assert wait_for(lambda: received_lines(1) == ["ERROR 1", "ERROR 3"], query)
        assert wait_for(lambda: sorted(file_lines()) == sorted(first), query)
    finally:
        query.stop()
    # Written while nothing was running: a restart picks it up from the checkpoint.
    with open(log, "a") as handle:
        handle.write("ERROR 5\nERROR 6\nERROR 7\n")
    query = start()
    try:
        want = ["ERROR 5", "ERROR 6", "ERROR 7"]
        assert wait_for(lambda: received_lines(0) == first + want, query), batches_of(received, 0)
        assert wait_for(lambda: received_lines(1) == ["ERROR 1", "ERROR 3"] + want, query)
    finally:
        query.stop()
    assert batches_of(received, 0)[0] == first  # one poll, one batch, though only 3 were asked for
    assert not os.path.exists(received / "3")


def routes_for(spark, cases):
    rows = [
        {
            "route_id": i,
            "path": f"/log/{i}",
            "polling_frequency_ms": GOLDEN[c][1],
            "buffer_size": GOLDEN[c][2],
            "flush_interval_ms": GOLDEN[c][3],
            "destination": {"type": "file", "path": "/o"},
        }
        for i, c in enumerate(cases)
    ]
    return routes_table(spark, rows)


def test_table_buffer_follows_the_golden_schedules(spark, tmp_path):
    """Poll by poll in virtual time; polls without any event are left out."""
    tables = TableBuffer(spark, routes_for(spark, TABLE_CASES), str(tmp_path), started_ms=0)
    flushed = {i: [] for i in range(len(TABLE_CASES))}
    events = sorted(
        {-(-a // 500) * 500 for c in TABLE_CASES for a in GOLDEN[c][0]}
        | {at for c in TABLE_CASES for at, _, _ in GOLDEN[c][-1]}
    )
    previous = 0
    for epoch, now in enumerate(events):
        rows = [
            (i, n, f"line {n}")
            for i, c in enumerate(TABLE_CASES)
            for n, a in enumerate(GOLDEN[c][0])
            if previous < a <= now
        ]
        routed = spark.createDataFrame(rows, "route_id long, offset long, line string")
        for repeat in range(2 if epoch % 3 == 0 else 1):  # a repeated micro-batch changes nothing
            batches = tables.poll(routed, epoch, now + repeat)
        for row in batches.collect() if batches is not None else []:
            flushed[row["route_id"]].append(row)
        previous = now
    for i, c in enumerate(TABLE_CASES):
        got = [(r["flush_at"], r["n_entries"], r["reason"]) for r in flushed[i]]
        assert got == GOLDEN[c][-1], c
        assert [r["batch_id"] for r in flushed[i]] == list(range(1, len(got) + 1))
        lines = [e["line"] for r in flushed[i] for e in r["entries"]]
        assert lines == [f"line {n}" for n in range(len(GOLDEN[c][0]))]
    kept = sorted(os.listdir(tmp_path / "clock"), key=lambda x: int(x.split("=")[1]))
    assert kept == [f"epoch={len(events) - 2}", f"epoch={len(events) - 1}"]
    assert len(os.listdir(tmp_path / "lines")) <= 2


def test_table_buffer_merges_what_waits(spark, tmp_path):
    """A quiet route among busy ones: few segments, and every line once, in order."""
    size, interval, busy = 1000, 5000, [{0, 1}, {0}, {0}]
    rows = [
        {"route_id": i, "path": f"/log/{i}", "polling_frequency_ms": 500, "buffer_size": b,
         "flush_interval_ms": interval, "destination": {"type": "file", "path": "/o"}}
        for i, b in enumerate([size, 2])
    ]
    tables = TableBuffer(spark, routes_table(spark, rows), str(tmp_path), started_ms=0, fan=2)
    assert tables.pending_lines().count() == tables.flush_log().count() == 0
    got, most, n_polls = {0: [], 1: []}, 0, 10
    for epoch in range(n_polls):
        lines = [(r, epoch, f"{r}: {epoch}") for r in busy[epoch % 3]]
        routed = spark.createDataFrame(lines, "route_id long, offset long, line string")
        for repeat in range(2 if epoch % 4 == 3 else 1):  # a repeated micro-batch changes nothing
            batches = tables.poll(routed, epoch, 500 * (epoch + 1) + repeat)
            found = batches.collect() if batches is not None else []
        for row in found:
            got[row["route_id"]].append([e["line"] for e in row["entries"]])
        most = max(most, len(os.listdir(tmp_path / "lines")))
        if epoch == n_polls - 2:
            held = {(r["route_id"], r["line"]) for r in tables.pending_lines().collect()}
            assert held == {(0, f"0: {e}") for e in range(n_polls - 1)} | {(1, "1: 6")}
    assert got[0] == [[f"0: {e}" for e in range(n_polls)]]
    assert sum(got[1], []) == [f"1: {e}" for e in range(0, n_polls, 3)]
    # One or two segments of each of three levels, and that of this poll.
    assert most <= 2 * 3 + 1
    log = {(r["route_id"], r["reason"]): r[2:] for r in tables.flush_log().collect()}
    assert log == {
        (0, "time elapsed"): (1, n_polls, n_polls),
        (1, "buffer full"): (2, 4, 2),
    }


def test_table_buffer_cuts_large_batches_into_ordered_parts(spark, tmp_path):
    tables = TableBuffer(
        spark, routes_for(spark, ["seven lines"]), str(tmp_path), 0, max_part_lines=4, slice_span=3
    )
    for epoch, (low, high) in enumerate([(0, 4), (4, 9)]):
        routed = spark.range(low, high).select(
            F.lit(0).cast("long").alias("route_id"),
            F.col("id").alias("offset"),
            F.format_string("line %d", "id").alias("line"),
        )
        batches = tables.poll(routed, epoch, 500 * (epoch + 1))
    rows = batches.orderBy("part").collect()
    assert [e["line"] for r in rows for e in r["entries"]] == [f"line {n}" for n in range(9)]
    # Slices of three offsets, kept apart by micro-batch: 0-2, 3 | 4-5, 6-8.
    assert [r["n_entries"] for r in rows] == [3, 1, 2, 3]
    assert {r["batch_id"] for r in rows} == {1}


def test_table_buffer_keeps_to_each_route_s_own_polls(spark, tmp_path):
    routes = routes_for(spark, ["burst"]).withColumn("polling_frequency_ms", F.lit(1000).cast("long"))
    tables = TableBuffer(spark, routes, str(tmp_path), started_ms=0)
    sizes = []
    for epoch, now in enumerate([1000, 1300, 1600, 2050, 2100]):
        routed = spark.range(6).select(
            F.lit(0).cast("long").alias("route_id"),
            (F.col("id") + 6 * epoch).alias("offset"),
            F.lit("x").alias("line"),
        )
        batches = tables.poll(routed, epoch, now)
        sizes.append(0 if batches is None else batches.first()["n_entries"])
    assert sizes == [6, 0, 0, 18, 0]


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
for name in ("stream_tail", "stream_dual_trigger"):
    print(name, entry.queries()[name](spark, {sf_dir!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason=f"{SF_DIR} is not there")
def test_streams_run_from_any_folder(tmp_path):
    """Workers of streams see neither the working folder nor files sent to executors."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ELSEWHERE.format(root=ROOT, sf_dir=SF_DIR)
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "stream_tail" in done.stdout and "stream_dual_trigger" in done.stdout


@pytest.mark.parametrize("buffer", ["table", "state"])
def test_what_cannot_be_shipped_is_set_aside(spark, tmp_path, buffer):
    log, out = tmp_path / "app.log", str(tmp_path / "out")
    log.write_text("")
    received = tmp_path / "received"
    received.mkdir()
    route = {
        "route_id": 0, "path": str(log), "polling_frequency_ms": 200, "buffer_size": 1,
        "destination": {"type": "http", "endpoint": "http://e"},
    }
    routes = normalize_routes(routes_table(spark, [route]))
    query = start_shipping(spark, routes, out, recording(str(received)), buffer=buffer)
    try:
        assert wait_for(lambda: query.lastProgress is not None, query)
        log.write_bytes(b"good\nbad \xff\nfine\n")
        assert wait_for(lambda: sum(batches_of(received, 0), []) == ["good", "fine"], query)
        assert wait_for(lambda: os.path.isdir(f"{out}/quarantine"), query)
        time.sleep(1)
    finally:
        query.stop()
    (row,) = spark.read.parquet(f"{out}/quarantine").collect()
    line = row["line"] if buffer == "table" else bytes.fromhex(row["line"])
    assert (row["path"], bytes(line)) == (str(log), b"bad \xff")


def test_destination_groups(spark):
    destinations = [
        {"type": "http", "endpoint": "http://Host:8000/a"},
        {"type": "http", "endpoint": "http://u:p@host:8000/b?c"},
        {"type": "http", "endpoint": "https://host:8000/a"},
        {"type": "elasticsearch", "url": "http://host:8000", "index": "i"},
        {"type": "syslog", "host": "host"},
        {"type": "file", "path": "/x"},
        {"type": "file", "path": "/y"},
    ]
    rows = [
        {"route_id": i, "path": "/l", "polling_frequency_ms": 1, "destination": d}
        for i, d in enumerate(destinations)
    ]
    routes = normalize_routes(routes_table(spark, rows))
    found = routes.select("route_id", destination_group(F.col("destination"))).collect()
    assert [group for _, group in sorted(map(tuple, found))] == [
        "http://host:8000", "http://host:8000", "https://host:8000", "http://host:8000",
        "udp://host:514", "file", "file",
    ]


def test_a_blocked_destination_delays_its_own_routes_only(spark, tmp_path, monkeypatch):
    log, received, gate = tmp_path / "app.log", tmp_path / "received", str(tmp_path / "open")
    log.write_text("")
    received.mkdir()
    out = str(tmp_path / "out")
    record = recording(str(received))

    def transport(request, payload):
        if request["url"] == "http://stuck":
            while not os.path.exists(gate):
                time.sleep(0.05)
        return record(request, payload)

    rows = [
        {"destination": {"type": "http", "endpoint": "http://stuck"}},
        {"destination": {"type": "http", "endpoint": "http://quick/a"}},
        {"destination": {"type": "file", "path": out}},
    ]
    rows = [
        {"route_id": i, "path": str(log), "polling_frequency_ms": 200, "buffer_size": 1, **row}
        for i, row in enumerate(rows)
    ]
    routes = normalize_routes(routes_table(spark, rows))
    pools = set()

    def delivered(session, *args, **kwargs):
        pools.add(session.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return deliver(session, *args, **kwargs)

    deliver = ship.deliver
    monkeypatch.setattr(ship, "deliver", delivered)
    work = str(tmp_path / "work")
    queries = start_isolated(spark, routes, work, transport)
    assert set(queries) == {"http://stuck", "http://quick", "file"}

    def sent(route_id):
        return sum(batches_of(received, route_id), [])

    def in_file():
        rows = spark.read.schema("path string, line string").json(out).collect()
        return sorted(r["line"] for r in rows)

    try:
        for query in queries.values():
            assert wait_for(lambda: query.lastProgress is not None, query)
        for n in range(3):
            with open(log, "a") as handle:
                handle.write(f"line {n}\n")
            want = [f"line {i}" for i in range(n + 1)]
            # Poll after poll goes out while the first request to the other waits.
            assert wait_for(lambda: sent(1) == want, queries["http://quick"])
            assert wait_for(lambda: in_file() == want, queries["file"])
        assert sent(0) == []
        open(gate, "w").close()
        assert wait_for(lambda: sent(0) == want, queries["http://stuck"])
    finally:
        open(gate, "w").close()
        for query in queries.values():
            query.stop()
    assert sorted(os.listdir(work)) == sorted(f"group={group_folder(g)}" for g in queries)
    assert pools == {group_folder(g) for g in queries}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
