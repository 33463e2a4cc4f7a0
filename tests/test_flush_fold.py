"""The chunked fold against a poll-by-poll model."""

from __future__ import annotations

import random
import time
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import batching as B
from millrace.operators import flush_kernel
from millrace.operators.flush_kernel import Chunk, Map, compose, flushes, follow, summarise


def poll_by_poll(counts: dict[int, int], size: int, every: int, freq: int, polls: int):
    """What a process does that wakes up at every poll."""
    buffered, last, out = 0, 0, []
    for k in range(1, polls + 1):
        buffered += counts.get(k, 0)
        full, elapsed = buffered >= size, (k - last) * freq >= every
        if (full or elapsed) and buffered:
            out.append((k, buffered, full))
            buffered, last = 0, k
    return out


def chunked(counts: dict[int, int], size: int, every: int, freq: int, width: int):
    interval = max(1, -(-every // freq))
    width = max(width, interval)
    members: dict[int, list] = {}
    for k, n in sorted(counts.items()):
        c = (k - 1) // width
        members.setdefault(c, []).append((k, n))
        if k > (c + 1) * width - interval + 1:
            members.setdefault(c + 1, []).append((k, n))
    chunks = {
        c: Chunk([k for k, _ in m], [n for _, n in m], c * width + 1, (c + 1) * width, size, interval)
        for c, m in members.items()
    }
    out = []
    maps = [(c, Map(chunks[c].idle, summarise(chunks[c]))) for c in sorted(chunks)]
    for c, entry, done in follow(maps, 0, 0):
        assert done == len(out)
        out += [(at, sum(chunks[c].counts[b:e]), full) for at, b, e, full in flushes(chunks[c], entry)]
    return out


@settings(max_examples=400, deadline=None)
@given(
    counts=st.dictionaries(st.integers(1, 150), st.integers(1, 9), max_size=60),
    size=st.integers(1, 25),
    every=st.one_of(st.integers(0, 90), st.sampled_from([10**9, 2**60])),
    freq=st.sampled_from([1, 3, 10]),
    width=st.sampled_from([1, 4, 13, 50, 1000]),
)
def test_chunked_fold_equals_the_poll_loop(counts, size, every, freq, width):
    want = poll_by_poll(counts, size, every, freq, 400)
    for share in (0, 10**9) if every < 1000 else (0,):  # follow stretches, or use arrays
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(flush_kernel, "DENSE_SHARE", share)
            found = chunked(counts, size, every, freq, width)
            assert [flush for flush in found if flush[0] <= 400] == want


@settings(max_examples=200, deadline=None)
@given(
    counts=st.dictionaries(st.integers(1, 150), st.integers(1, 9), min_size=1, max_size=60),
    size=st.integers(1, 25),
    interval=st.integers(1, 60),
    width=st.sampled_from([1, 4, 13, 50]),
    cut=st.integers(0, 40),
)
def test_composed_maps_equal_one_after_the_other(counts, size, interval, width, cut):
    width = max(width, interval)
    members: dict[int, list] = {}
    for k, n in sorted(counts.items()):
        c = (k - 1) // width
        members.setdefault(c, []).append((k, n))
        if k > (c + 1) * width - interval + 1:
            members.setdefault(c + 1, []).append((k, n))
    maps = []
    for c, m in sorted(members.items()):
        chunk = Chunk([k for k, _ in m], [n for _, n in m], c * width + 1, (c + 1) * width, size, interval)
        maps.append(Map(chunk.idle, summarise(chunk)))
    cut = 1 + cut % len(maps)
    # However the maps are bracketed, and for every entry.
    left = reduce(compose, maps[:cut])
    whole = compose(left, reduce(compose, maps[cut:])) if maps[cut:] else left
    for entry in range(maps[0].idle - 2, maps[0].idle + interval + 1):
        at, n = entry, 0
        for one in maps:
            at, more = one(at)
            n += more
        assert whole(entry) == (at, n)


def test_long_intervals_cost_nothing():
    began = time.perf_counter()
    for interval in (10**9, 2**60):
        chunk = Chunk([5, 900, 10**6, 10**8], [1, 2, 3, 4], 1, interval, 100, interval)
        assert len(summarise(chunk)) < 12
    assert time.perf_counter() - began < 1


def test_an_interval_that_never_ends(golden):
    lines, routes = golden
    never = routes.withColumn("flush_interval_ms", F.lit(2**62))
    folded = B.fold_ticks(B.tick_counts(B.tick_slices(B.with_ticks(lines))), never, 30_000)
    reasons = {r["reason"] for r in B.flush_schedule(folded).collect()}
    assert reasons == {"buffer full"}


def test_buffer_size_zero_flushes_every_non_empty_poll():
    assert chunked({2: 1, 5: 3}, 0, 1000, 1, 4) == [(2, 1, True), (5, 3, True)]


# arrivals in ms, poll period, buffer size, flush interval, flushes
GOLDEN = {
    "seven lines": (range(2000, 3201, 200), 500, 5, 10_000,
                    [(3000, 6, "buffer full"), (13000, 1, "time elapsed")]),
    "two lines": ([2000, 3000], 600, 7, 12_000, [(12000, 2, "time elapsed")]),
    "burst": ([1001] * 12, 500, 5, 10_000, [(1500, 12, "buffer full")]),
    "idle start": ([15001], 500, 5, 10_000, [(15500, 1, "time elapsed")]),
    "idle then two": ([15001, 15501, 15502], 500, 5, 10_000,
                      [(15500, 1, "time elapsed"), (25500, 2, "time elapsed")]),
    "every poll": ([100, 900, 950], 500, 0, 10_000, [(500, 1, "buffer full"), (1000, 2, "buffer full")]),
    "no wait": ([100, 900, 950], 500, 9, 0, [(500, 1, "time elapsed"), (1000, 2, "time elapsed")]),
}


@pytest.fixture(scope="module")
def golden(spark):
    lines, routes = [], []
    for i, (arrivals, freq, size, every, _) in enumerate(GOLDEN.values()):
        routes.append((i, f"/log/{i}", freq, size, every))
        lines += [(i, freq, n, at * 1000, f"line {n}") for n, at in enumerate(arrivals)]
    return (
        spark.createDataFrame(
            lines, "route_id long, polling_frequency_ms long, offset long, arrival_us long, line string"
        ),
        spark.createDataFrame(
            routes,
            "route_id long, path string, polling_frequency_ms long, buffer_size long, flush_interval_ms long",
        ),
    )


@pytest.mark.parametrize("chunk_ticks", [1, 7, B.CHUNK_TICKS])
def test_golden_schedules(golden, chunk_ticks):
    lines, routes = golden
    slices = B.tick_slices(B.with_ticks(lines))
    folded = B.fold_ticks(B.tick_counts(slices), routes, 30_000, chunk_ticks)
    rows = B.flush_schedule(folded).orderBy("route_id", "batch_id").collect()
    for i, (name, case) in enumerate(GOLDEN.items()):
        mine = [r for r in rows if r["route_id"] == i]
        assert [(r["flush_at"], r["n_entries"], r["reason"]) for r in mine] == case[-1], name
        assert [r["batch_id"] for r in mine] == list(range(1, len(mine) + 1)), name


@pytest.mark.parametrize("chunk_ticks, map_rows", [(8, 100), (64, 2_000)])
def test_trees_of_any_depth_equal_the_poll_loop(spark, monkeypatch, chunk_ticks, map_rows):
    """Intervals below, at and far beyond a chunk; bursts, gaps, buffers of any size."""
    monkeypatch.setattr(B, "MAP_ROWS", map_rows)
    monkeypatch.setattr(B, "MOST_MAPS", 5)
    rng = random.Random(chunk_ticks)
    polls, period = 600, 10
    sizes, intervals = [0, 1, 7, 40, 10**6], [0, 20, 70, 640, 2_500, 10**7, 2**62]
    routes = [(i, period, *pair) for i, pair in enumerate((s, e) for s in sizes for e in intervals)]
    ticks, counts = [], {}
    for i, *_ in routes:
        at = sorted(rng.sample(range(1, polls), rng.choice([3, 40, 300])))
        if i % 3 == 0:  # a long gap
            at = [k for k in at if not 100 < k < 400]
        counts[i] = {k: rng.choice([1, 1, 2, 30]) for k in at}
        ticks += [(i, k * period, n) for k, n in counts[i].items()]
    folded = B.fold_ticks(
        spark.createDataFrame(ticks, "route_id long, tick long, n long").repartition(3),
        spark.createDataFrame(
            routes, "route_id long, polling_frequency_ms long, buffer_size long, flush_interval_ms long"
        ),
        (polls + 50) * period,
        chunk_ticks,
    )
    found = B.flush_schedule(folded).orderBy("route_id", "batch_id").collect()
    for i, _, size, every in routes:
        want = poll_by_poll(counts[i], size, every, period, polls + 50)
        mine = [r for r in found if r["route_id"] == i]
        assert [(r["flush_at"] // period, r["n_entries"], r["reason"] == B.BUFFER_FULL) for r in mine] == want
        assert [r["batch_id"] for r in mine] == list(range(1, len(mine) + 1))


def test_no_group_grows_with_the_interval(spark):
    """A long history and an endless interval: chunks stay chunks."""
    ticks = spark.range(1, 40_001).selectExpr("0L AS route_id", "id * 250 AS tick", "0L AS slice", "1L AS n")
    routes = spark.createDataFrame(
        [(0, 250, 100, 2**62)],
        "route_id long, polling_frequency_ms long, buffer_size long, flush_interval_ms long",
    )
    placed = ticks.join(B._settings(routes, 1_000), "route_id").withColumn("k", F.expr("tick div period"))
    chunks = B._long_chunks(placed, 1_000).groupBy("chunk").count().collect()
    assert len(chunks) == 40 and max(r["count"] for r in chunks) <= 2_000
    assert B.flush_schedule(B.fold_ticks(ticks, routes, None, chunk_ticks=1_000)).count() == 400


def test_lines_at_the_start_are_skipped_and_the_rest_may_stay_pending(golden):
    lines, routes = golden
    early = lines.withColumn("arrival_us", F.lit(0).cast("bigint"))
    assert B.batch_lines(early, routes, 30_000).isEmpty()
    late = B.batch_lines(lines.filter("route_id = 1"), routes, 11_000)
    assert B.pending_lines(late).count() == 2
    assert B.collect_batches(late, routes).isEmpty()


@pytest.mark.parametrize("slice_span", [3, B.SLICE_SPAN])
def test_every_line_is_in_one_batch_in_order(golden, slice_span):
    lines, routes = golden
    batches = B.collect_batches(B.batch_lines(lines, routes, 30_000, slice_span), routes)
    rows = batches.orderBy("route_id", "batch_id").collect()
    for i, case in enumerate(GOLDEN.values()):
        mine = [r for r in rows if r["route_id"] == i]
        got = [e["line"] for r in mine for e in r["entries"]]
        assert got == [f"line {n}" for n in range(len(case[0]))]
        assert [r["n_entries"] for r in mine] == [n for _, n, _ in case[-1]]
        assert {e["path"] for r in mine for e in r["entries"]} == {f"/log/{i}"}


def test_an_oversized_batch_is_cut_into_ordered_parts(golden):
    lines, routes = golden
    assigned = B.batch_lines(lines.filter("route_id = 2"), routes, 30_000, slice_span=5)
    rows = B.collect_batches(assigned, routes, max_part_lines=5, slice_span=5).orderBy("part").collect()
    assert [r["n_entries"] for r in rows] == [5, 5, 2]
    assert [e["line"] for r in rows for e in r["entries"]] == [f"line {n}" for n in range(12)]


def test_parts_follow_ticks_and_slices_and_keep_the_limit(spark):
    """Offsets that start again in a later poll, dense and sparse ones."""
    lines = [(tick, offset) for tick, start in ((100, 0), (200, 5_000), (300, 0)) for offset in range(start, start + 700)]
    lines += [(400, offset * 97) for offset in range(300)]
    df = spark.createDataFrame(
        [(0, 100, offset, tick * 1000, f"{tick} {offset}") for tick, offset in lines],
        "route_id long, polling_frequency_ms long, offset long, arrival_us long, line string",
    ).repartition(3)
    routes = spark.createDataFrame(
        [(0, "/p", 100, 10**6, 1_000)],
        "route_id long, path string, polling_frequency_ms long, buffer_size long, flush_interval_ms long",
    )
    batches = B.collect_batches(
        B.batch_lines(df, routes, 10_000, slice_span=40), routes, max_part_lines=100, slice_span=40
    )
    rows = batches.orderBy("batch_id", "part").collect()
    assert len({r["batch_id"] for r in rows}) == 1 and len(rows) > 2_400 / 100
    assert max(r["n_entries"] for r in rows) <= 100
    assert [e["line"] for r in rows for e in r["entries"]] == [f"{t} {o}" for t, o in lines]
