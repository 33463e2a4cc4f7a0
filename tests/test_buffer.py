"""The stateful buffer's decisions, with its state held in plain objects."""

from __future__ import annotations

import tracemalloc

import pandas as pd
import pytest

from millrace.streaming import buffer
from millrace.streaming.buffer import BufferSettings, FlushProcessor
from test_flush_fold import GOLDEN, poll_by_poll


class Store:
    """Stands in for the value state, list state, timers and clock of one key."""

    def __init__(self):
        self.value, self.items, self.timers, self.now = None, [], set(), 0

    # handle
    def getListState(self, name, schema):
        return _List(self)

    def getValueState(self, name, schema):
        return _Value(self)

    def registerTimer(self, at):
        assert at > self.now
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(sorted(self.timers))

    # timer values
    def getCurrentProcessingTimeInMs(self):
        return self.now


class _Value:
    def __init__(self, store):
        self.store = store

    def exists(self):
        return self.store.value is not None

    def get(self):
        return self.store.value

    def update(self, value):
        self.store.value = value


class _List:
    def __init__(self, store):
        self.store = store

    def exists(self):
        return bool(self.store.items)

    def get(self):
        return iter(list(self.store.items))

    def appendList(self, rows):
        self.store.items += rows

    def clear(self):
        self.store.items = []


def run(arrivals, freq, size, every, trigger, until):
    """Micro-batches every ``trigger`` ms; returns flushes and the shipped lines."""
    store = Store()
    processor = FlushProcessor({0: BufferSettings("/p", freq, size, every)}, 0, max_part_lines=4)
    processor.init(store)
    flushed, shipped, previous = [], [], 0

    def take(frames):
        for pdf in frames:
            parts = pdf.to_dict("records")
            flushed.append((store.now, sum(p["n_entries"] for p in parts), parts[0]["reason"]))
            assert [p["part"] for p in parts] == list(range(len(parts)))
            shipped.extend(e["line"] for p in parts for e in p["entries"])

    for now in range(trigger, until + 1, trigger):
        store.now = now
        rows = [(n, f"line {n}") for n, at in enumerate(arrivals) if previous < at <= now]
        if rows:
            pdf = pd.DataFrame(rows[::-1], columns=["offset", "line"])
            take(processor.handleInputRows((0,), iter([pdf.iloc[:1], pdf.iloc[1:]]), store))
        for timer in [t for t in sorted(store.timers) if t <= now]:
            store.timers.discard(timer)
            take(processor.handleExpiredTimer((0,), store, None))
        previous = now
    return flushed, shipped


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_schedules(name):
    arrivals, freq, size, every, want = GOLDEN[name]
    flushed, shipped = run(arrivals, freq, size, every, freq, 30_000)
    assert flushed == want
    assert shipped == [f"line {n}" for n in range(len(arrivals))]


@pytest.mark.parametrize("size", [1, 3, 7, 40])
@pytest.mark.parametrize("every", [0, 700, 2500])
def test_faster_triggers_keep_to_the_route_s_polls(size, every):
    arrivals = [137 * i % 9000 + 1 for i in range(60)]
    arrivals.sort()
    flushed, shipped = run(arrivals, 500, size, every, 100, 20_000)
    counts: dict[int, int] = {}
    for at in arrivals:
        counts[-(-at // 500)] = counts.get(-(-at // 500), 0) + 1
    want = poll_by_poll(counts, size, every, 500, 40)
    # A trigger between two polls already collects lines; the flush waits for the poll.
    assert [(at // 500, n, r == "buffer full") for at, n, r in flushed] == want
    assert shipped == [f"line {n}" for n in range(sum(n for _, n, _ in want))]


def test_lines_sorted_in_runs_are_those_sorted_at_once(monkeypatch):
    monkeypatch.setattr(buffer, "READ_LINES", 3)
    monkeypatch.setattr(buffer, "MOST_RUNS", 4)
    offsets = [(7 * i) % 50 for i in range(200)]
    frame = pd.DataFrame({"offset": offsets, "line": [f"line {i}" for i in range(200)]})
    frame.loc[11, "line"] = None
    want = frame.sort_values("offset", kind="stable")["line"].tolist()
    for run_lines in (1, 20, 64, 1000):
        fresh = buffer.SortedLines(run_lines)
        for at in range(0, 200, 10):
            fresh.add(frame.iloc[at : at + 10])
        assert fresh.n == 200 and list(fresh) == want
        fresh.close()
    late = pd.DataFrame({"offset": [None, 2.0, None, 1.0], "line": ["c", "b", "d", "a"]})
    fresh = buffer.SortedLines(2)
    fresh.add(late.iloc[:2])
    fresh.add(late.iloc[2:])
    assert list(fresh) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("kept", [False, True])
def test_a_task_holds_no_whole_poll(monkeypatch, kept):
    """Ten times the lines take no more memory, whether they are flushed or kept."""

    for name, n in {"RUN_LINES": 1000, "READ_LINES": 50, "MOST_RUNS": 8, "FRAME_LINES": 1000}.items():
        monkeypatch.setattr(buffer, name, n, raising=False)
    peaks = []
    for n in (5_000, 50_000):
        store = Store()
        store.getListState = lambda name, schema, store=store: _Kept(store)
        store.now = 1000
        settings = BufferSettings("/p", 2000 if kept else 500, 10, 10)
        processor = FlushProcessor({0: settings}, 0, max_part_lines=1000)
        processor.init(store)
        frames = (
            pd.DataFrame({"offset": range(at, at - 500, -1), "line": [f"{i:0100}" for i in range(500)]})
            for at in range(n, 0, -500)
        )
        tracemalloc.start()
        out = 0
        for pdf in processor.handleInputRows((0,), frames, store):
            out += sum(pdf["n_entries"])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (out, store.kept) == ((0, n) if kept else (n, 0))
    assert peaks[1] < 2 * peaks[0]


class _Kept:
    """A list state that only counts."""

    def __init__(self, store):
        self.store, store.kept = store, 0

    def exists(self):
        return False

    def appendList(self, rows):
        self.store.kept += len(rows)

    def clear(self):
        self.store.kept = 0
