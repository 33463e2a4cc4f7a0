"""Size-or-time batching of routed lines.

Input lines carry ``route_id``, ``polling_frequency_ms``, ``offset`` (order and
identity within a path) and ``arrival_us`` (microseconds since the routes were
started), plus any payload columns.

Lines are first reduced to counts per poll tick, which combines before the
shuffle.  Only these counts enter the order-dependent fold; lines are attached
to their batch afterwards by an equi-join.  A tick with very many lines is cut
into slices of the offset range, so that neither the join nor the collection of
a batch ever has to bring an unbounded group into one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.flush_kernel import Chunk, Map, compose, flushes, follow, summarise
from millrace.session import join_checked, materialised

# Why a batch was flushed.
BUFFER_FULL = "buffer full"
TIME_ELAPSED = "time elapsed"

# Offsets per slice: at most this many lines share a join key.
SLICE_SPAN = 1 << 14

# Poll ticks per fold task, with up to as many of the chunk before; a task holds
# a (tick, count) pair per slice of each.
CHUNK_TICKS = 1 << 17

# Rows of chunk summaries that one task chains.
MAP_ROWS = 1 << 18
MOST_MAPS = 1 << 12

# Longer intervals count as this long: about 70 million years.
LONGEST_MS = 1 << 61

# A batch of more lines is delivered in several parts, in order.
MAX_PART_LINES = 100_000

_TICK_BATCHES = (
    "route_id bigint, tick bigint, slice bigint, n bigint, batch_id bigint, flush_at bigint, "
    "n_entries bigint, before bigint, full boolean, opens boolean"
)
_MAPS = (
    "route_id bigint, node bigint, fan bigint, idle bigint, low bigint, high bigint, "
    "leave bigint, n_flushes bigint, shift boolean"
)
_ENTRIES = "route_id bigint, node bigint, entry bigint, flushes_before bigint"


def with_ticks(
    routed: DataFrame, slice_span: int = SLICE_SPAN, horizon_ms: int | None = None
) -> DataFrame:
    """Add ``tick`` (ms of the poll that sees the line) and ``slice``.

    Polls run at multiples of the route's period.  Whatever is there at the
    first one is skipped, so lines at or before time zero drop out, as do lines
    the routes no longer see by ``horizon_ms``.
    """
    period_us = F.col("polling_frequency_ms") * 1000
    poll = F.call_function("div", F.col("arrival_us") + period_us - 1, period_us)
    ticked = (
        routed.filter(F.col("arrival_us") > 0)
        .withColumn("tick", poll * F.col("polling_frequency_ms"))
        .withColumn("slice", F.call_function("div", F.col("offset"), F.lit(slice_span)))
    )
    # Spelled out so that no later join infers them on one side only, which
    # would keep equal scans from being shared.
    seen = F.col("tick").isNotNull() & F.col("slice").isNotNull()
    return ticked.filter(seen if horizon_ms is None else seen & (F.col("tick") <= horizon_ms))


def tick_slices(ticked: DataFrame) -> DataFrame:
    """Lines per ``(route_id, tick, slice)``."""
    return ticked.groupBy("route_id", "tick", "slice").agg(F.count(F.lit(1)).alias("n"))


def tick_counts(slices: DataFrame) -> DataFrame:
    """Lines per ``(route_id, tick)``."""
    return slices.groupBy("route_id", "tick").agg(F.sum("n").alias("n"))


def fold_ticks(
    ticks: DataFrame,
    routes: DataFrame,
    horizon_ms: int | None = None,
    chunk_ticks: int = CHUNK_TICKS,
    small: bool | None = None,
) -> DataFrame:
    """Assign every non-empty tick to the flush that carries it.

    ``ticks`` has ``(route_id, tick, n)``, several rows per tick allowed, and
    may have ``slice``.  Returns ``(route_id, tick, slice, n, batch_id, flush_at,
    n_entries, before, reason, opens)`` with one row per tick and slice; ``before``
    counts the lines of the batch in earlier ticks and slices, ``opens`` marks the first row of a batch.
    With ``horizon_ms`` the routes stop there: later ticks disappear and ticks
    still buffered have no batch.

    The fold runs in steps over chunks of about ``chunk_ticks`` polls, so that one
    busy route is spread over many tasks: summarise each chunk for every way of
    entering it, compose the summaries to a tree of maps, go down the tree to find the
    one true entry of each chunk, and replay the chunks.  No task sees more than
    two chunks of ticks and ``MAP_ROWS`` rows of maps, however long the history
    and the flush interval are, as long as a buffer holds no more than a chunk.
    """
    if horizon_ms is not None:
        ticks = ticks.filter(F.col("tick") <= horizon_ms)
    return _fold(ticks, routes, horizon_ms, chunk_ticks, small)


def _fold(
    ticks: DataFrame, routes: DataFrame, horizon_ms: int | None, chunk_ticks: int, small: bool | None
) -> DataFrame:
    settings = _settings(routes, chunk_ticks)
    if horizon_ms is None:
        horizon = ticks.agg(F.max("tick")).first()[0] or 0
    else:
        horizon = horizon_ms
    chunk_count = F.expr(f"{int(horizon)}L div period div {chunk_ticks} + 2").cast("double")
    asked = settings.agg(
        F.max(F.col("interval") > chunk_ticks).alias("long"),
        F.max(F.ceil(F.log(chunk_count) / F.log("fan") - 1e-9)).alias("levels"),
    ).first()
    if "slice" not in ticks.columns:
        ticks = ticks.withColumn("slice", F.lit(0).cast("bigint"))
    placed = join_checked(ticks, settings, ["route_id"], spread=["tick"], small=small).withColumn(
        "k", F.call_function("div", F.col("tick"), F.col("period"))
    )
    chunks = _short_chunks(placed.filter(F.col("interval") <= chunk_ticks), chunk_ticks)
    if asked["long"]:
        long = placed.filter(F.col("interval") > chunk_ticks)
        chunks = chunks.unionByName(_long_chunks(long, chunk_ticks))
    maps = chunks.groupBy("route_id", "chunk").applyInPandas(_summarise_group, _MAPS)
    entries = _entries(maps, int(asked["levels"] or 1))
    folded = (
        chunks.join(entries.withColumnRenamed("node", "chunk"), ["route_id", "chunk"])
        .groupBy("route_id", "chunk")
        .applyInPandas(_replay_group, _TICK_BATCHES)
    )
    return _within_horizon(folded, horizon_ms)


def _settings(routes: DataFrame, chunk_ticks: int) -> DataFrame:
    """Routes in units of polls; ``fan`` is how many chunk maps a task chains."""
    period = F.col("polling_frequency_ms")
    # No time stamp lies further ahead than the longest interval.
    interval = F.least(
        F.greatest(
            F.lit(1), F.call_function("div", F.col("flush_interval_ms") - 1, period) + 1
        ),
        F.call_function("div", F.lit(LONGEST_MS), period),
    )
    # Entries older than the interval, or than the lines a buffer holds, are one.
    map_rows = 2 * F.least(F.col("interval"), F.greatest("buffer_size", F.lit(0))) + 16
    fan = F.call_function("div", F.lit(MAP_ROWS), map_rows)
    return routes.select(
        "route_id",
        period.alias("period"),
        "buffer_size",
        interval.alias("interval"),
    ).withColumn("fan", F.least(F.lit(MOST_MAPS), F.greatest(F.lit(2), fan)).cast("bigint"))


_TICK = ["period", "buffer_size", "interval", "fan"]


def _short_chunks(placed: DataFrame, chunk_ticks: int) -> DataFrame:
    """Chunks of equal time; ticks an interval before the next chunk are in it too."""
    width = F.lit(chunk_ticks).cast("bigint")
    chunk = F.call_function("div", F.col("k") - 1, width)
    looked_back_at = F.col("k") > (F.col("chunk") + 1) * width - F.col("interval") + 1
    chunk_ids = F.when(looked_back_at, F.array("chunk", F.col("chunk") + 1)).otherwise(
        F.array("chunk")
    )
    return placed.withColumn("chunk", chunk).select(
        "route_id",
        F.explode(chunk_ids).alias("chunk"),
        "k",
        "slice",
        F.col("n").cast("bigint").alias("n"),
        *_TICK,
    ).select(
        "*",
        (F.col("chunk") * width + 1).alias("first"),
        ((F.col("chunk") + 1) * width).alias("final"),
    )


def _long_chunks(placed: DataFrame, chunk_ticks: int) -> DataFrame:
    """Chunks of routes whose interval is longer than a chunk.

    Polls are counted by blocks of ``chunk_ticks``, and neighbouring blocks with
    few non-empty ones are one chunk.  A flush leaves an empty buffer, and a buffer
    never holds more than its size: only blocks that fewer than ``buffer_size`` lines
    follow are looked back at, however long the interval is.
    """
    width = F.lit(chunk_ticks).cast("bigint")
    in_blocks = placed.withColumn("block", F.call_function("div", F.col("k") - 1, width))
    before = Window.partitionBy("route_id").orderBy("block")
    # A row per block, then one per chunk: history divided by the chunk size.
    blocks = (
        in_blocks.groupBy("route_id", "block", *_TICK)
        .agg(F.count(F.lit(1)).alias("ticks"), F.sum("n").alias("lines"))
        .withColumn("chunk", F.call_function("div", F.sum("ticks").over(before) - F.col("ticks"), width))
        .withColumn("lines", F.sum("lines").over(before))
    )
    ordered = Window.partitionBy("route_id").orderBy("chunk")
    ends = blocks.groupBy("route_id", "chunk", "period").agg(
        F.max("block").alias("block"), F.max("lines").alias("lines")
    )
    end_of_block = (F.col("block") + 1) * width
    # Time goes on after the last tick, for what is still in the buffer.
    final = F.when(F.lead("chunk").over(ordered).isNull(), F.expr(f"{2 * LONGEST_MS}L div period"))
    bounds = ends.select(
        "route_id",
        F.struct(
            "chunk",
            (F.coalesce(F.lag(end_of_block).over(ordered), F.lit(0)) + 1).alias("first"),
            F.coalesce(final, end_of_block).alias("final"),
            F.coalesce(F.lag("lines").over(ordered), F.lit(0)).alias("lines"),
        ).alias("bound"),
    )
    of_route = bounds.groupBy("route_id").agg(F.collect_list("bound").alias("bounds"))

    def reaches(bound: Column) -> Column:
        later = bound["chunk"] > F.col("chunk")
        held = bound["lines"] - F.col("lines") < F.col("buffer_size")
        in_time = end_of_block >= bound["first"] - F.col("interval") - 1
        return (bound["chunk"] == F.col("chunk")) | (later & held & in_time)

    reached = blocks.join(of_route, "route_id").select(
        "route_id", "block", F.inline(F.filter("bounds", reaches))
    )
    return in_blocks.join(reached.drop("lines"), ["route_id", "block"]).select(
        "route_id",
        "chunk",
        "k",
        "slice",
        F.col("n").cast("bigint").alias("n"),
        *_TICK,
        "first",
        "final",
    )


def _entries(maps: DataFrame, levels: int) -> DataFrame:
    """The entry of every chunk, and the flushes before it.

    Up the tree, the maps of ``fan`` neighbours compose to one.  Down again, a node's
    entry is known and its children are gone through in order.
    """
    tree = [maps if levels == 1 else materialised(maps, "fold-maps")]
    parent = F.call_function("div", F.col("node"), F.col("fan")).alias("parent")
    while len(tree) < levels:
        tree.append(tree[-1].groupBy("route_id", parent).applyInPandas(_compose_group, _MAPS))
    # The history starts with an empty buffer and a clock at tick 0.
    begun = tree[-1].withColumns({"entry": F.lit(0), "flushes_before": F.lit(0)})
    found = begun.groupBy("route_id", parent).applyInPandas(_enter_group, _ENTRIES)
    for children in tree[-2::-1]:
        of_parent = found.withColumnRenamed("node", "parent")
        begun = children.select("*", parent).join(of_parent, ["route_id", "parent"])
        found = begun.groupBy("route_id", "parent").applyInPandas(_enter_group, _ENTRIES)
    return found


def _to_chunk(pdf: pd.DataFrame) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk, and the slices of its ticks: where each tick's begin, their numbers and lines."""
    head = pdf.iloc[0]
    k, slices, n = (pdf[name].to_numpy() for name in ("k", "slice", "n"))
    order = np.lexsort((slices, k))
    k, slices, n = k[order], slices[order], n[order]
    rows = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (slices[1:] != slices[:-1])))
    k, slices, n = k[rows], slices[rows], np.add.reduceat(n, rows)
    ticks, starts = np.unique(k, return_index=True)
    counts = np.add.reduceat(n, starts)
    first, buffer_size = int(head["first"]), int(head["buffer_size"])
    # No flush lies before lines that would have filled the buffer by now.
    back = int(np.searchsorted(ticks, first))
    since = np.cumsum(counts[:back][::-1])
    kept = back - int(np.searchsorted(since, buffer_size))
    chunk = Chunk(
        ticks=ticks[kept:].tolist(),
        counts=counts[kept:].tolist(),
        first=first,
        final=int(head["final"]),
        buffer_size=buffer_size,
        interval=int(head["interval"]),
    )
    return chunk, np.append(starts, len(n))[kept:], slices, n


def _rows_of(key: int, node: int, fan: int, one: Map) -> pd.DataFrame:
    runs = pd.DataFrame(one.runs, columns=["low", "high", "leave", "n_flushes", "shift"])
    for name, value in (("idle", one.idle), ("fan", fan), ("node", node), ("route_id", key)):
        runs.insert(0, name, value)
    return runs


def _maps_of(pdf: pd.DataFrame) -> list[tuple[int, Map]]:
    """Numbered maps in order."""
    columns = ["low", "high", "leave", "n_flushes", "shift"]
    return [
        (int(node), Map(int(rows["idle"].iloc[0]), list(zip(*[rows[c].tolist() for c in columns]))))
        for node, rows in pdf.sort_values(["node", "low"]).groupby("node", sort=True)
    ]


def _summarise_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    chunk, *_ = _to_chunk(pdf)
    return _rows_of(*key, int(pdf["fan"].iloc[0]), Map(chunk.idle, summarise(chunk)))


def _compose_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    whole = reduce(compose, [one for _, one in _maps_of(pdf)])
    return _rows_of(*key, int(pdf["fan"].iloc[0]), whole)


def _enter_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    start = int(pdf["entry"].iloc[0]), int(pdf["flushes_before"].iloc[0])
    out = pd.DataFrame(list(follow(_maps_of(pdf), *start)), columns=["node", "entry", "flushes_before"])
    out.insert(0, "route_id", key[0])
    return out


def _replay_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    (chunk, starts, slices, n), head = _to_chunk(pdf), pdf.iloc[0]
    period = int(head["period"])
    fired = np.array(list(flushes(chunk, int(head["entry"]))), dtype=np.int64).reshape(-1, 4)
    at, begin, end, full = fired.T
    # Ticks carried by the flushes of this chunk, in order and without gaps.
    ticks = slice(begin[0], end[-1]) if len(fired) else slice(0, 0)
    carried = slice(starts[ticks.start], starts[ticks.stop])
    counts, lengths = n[carried], starts[end] - starts[begin]
    opening = np.cumsum(lengths) - lengths
    opens = np.zeros(len(counts), dtype=bool)
    opens[opening] = True
    numbers = int(head["flushes_before"]) + 1 + np.arange(len(fired))
    sizes = np.add.reduceat(counts, opening) if len(fired) else counts
    before = np.cumsum(counts) - counts
    per_tick = np.diff(starts[ticks.start : ticks.stop + 1])
    return pd.DataFrame(
        {
            "route_id": key[0],
            "tick": np.repeat(np.asarray(chunk.ticks, dtype=np.int64)[ticks], per_tick) * period,
            "slice": slices[carried],
            "n": counts,
            "batch_id": np.repeat(numbers, lengths),
            "flush_at": np.repeat(at * period, lengths),
            "n_entries": np.repeat(sizes, lengths),
            "before": before - np.repeat(before[opening], lengths),
            "full": np.repeat(full.astype(bool), lengths),
            "opens": opens,
        }
    )


def _within_horizon(folded: DataFrame, horizon_ms: int | None) -> DataFrame:
    shipped = F.lit(True) if horizon_ms is None else F.col("flush_at") <= horizon_ms
    return folded.select(
        "route_id",
        "tick",
        "slice",
        "n",
        *[F.when(shipped, F.col(c)).alias(c) for c in ("batch_id", "flush_at", "n_entries", "before")],
        F.when(shipped, _reason(F.col("full"))).alias("reason"),
        (shipped & F.col("opens")).alias("opens"),
    )


def _reason(full: Column) -> Column:
    return F.when(full, F.lit(BUFFER_FULL)).otherwise(F.lit(TIME_ELAPSED))


def flush_schedule(folded: DataFrame) -> DataFrame:
    """One row per flush: ``(route_id, batch_id, flush_at, n_entries, reason)``."""
    return folded.filter("opens").select(
        "route_id", "batch_id", "flush_at", "n_entries", "reason"
    )


def flush_log(schedule: DataFrame) -> DataFrame:
    """Flushes per route and reason."""
    return schedule.groupBy("route_id", "reason").agg(
        F.count(F.lit(1)).alias("n_flushes"),
        F.sum("n_entries").alias("n_entries"),
        F.max("n_entries").alias("largest"),
    )


def assign_batches(ticked: DataFrame, folded: DataFrame) -> DataFrame:
    """Attach the batch columns of its tick and slice to every line.

    The batch columns are NULL for lines that were still buffered at the
    horizon.  The join key includes the slice, so no key exceeds the slice span;
    whether the counts side is small enough to broadcast is left to the run-time
    statistics.
    """
    of_slice = folded.select(
        "route_id", "tick", "slice", "batch_id", "flush_at", "n_entries", "before", "reason"
    )
    return ticked.join(of_slice, ["route_id", "tick", "slice"])


def batch_lines(
    routed: DataFrame,
    routes: DataFrame,
    horizon_ms: int | None = None,
    slice_span: int = SLICE_SPAN,
    chunk_ticks: int = CHUNK_TICKS,
    small: bool | None = None,
) -> DataFrame:
    """Routed lines with ``tick``, ``slice`` and the columns of their batch."""
    ticked = with_ticks(routed, slice_span, horizon_ms)
    # The fold adds up the slices of a tick itself, which saves a shuffle.
    folded = _fold(tick_slices(ticked), routes, horizon_ms, chunk_ticks, small)
    return assign_batches(ticked, folded)


def pending_lines(assigned: DataFrame) -> DataFrame:
    """Lines buffered but not flushed when the routes stopped."""
    return assigned.filter(F.col("batch_id").isNull())


def part_of(n_entries: Column, before: Column, max_part_lines: int, slice_span: int) -> Column:
    """The part that a slice of a batch is in.

    ``before`` counts the batch's lines in earlier slices.  A slice holds
    ``slice_span`` lines at most, so parts that slices may begin in for that many lines less
    never hold more than ``max_part_lines``.
    """
    room = max(1, max_part_lines - slice_span + 1)
    whole = n_entries <= max_part_lines
    return F.when(whole, F.lit(0)).otherwise(F.call_function("div", before, F.lit(room)))


def collect_batches(
    assigned: DataFrame,
    routes: DataFrame,
    max_part_lines: int = MAX_PART_LINES,
    small: bool | None = None,
    slice_span: int = SLICE_SPAN,
) -> DataFrame:
    """Gather each batch's entries in file order.

    Returns ``(route_id, path, batch_id, part, flush_at, reason, n_entries,
    entries)``.  A batch of up to ``max_part_lines`` lines is one row with part
    0.  A larger one, which a burst within one poll can produce, is cut between
    its slices into parts that follow each other in order, see :func:`part_of`.
    """
    part = part_of(F.col("n_entries"), F.col("before"), max_part_lines, slice_span)
    gathered = (
        assigned.filter(F.col("batch_id").isNotNull())
        .select(
            "route_id",
            "batch_id",
            part.cast("bigint").alias("part"),
            "flush_at",
            "reason",
            # Offsets start again when a file was replaced; polls never do.
            F.struct("tick", "offset", "line").alias("item"),
        )
        .groupBy("route_id", "batch_id", "part")
        .agg(
            F.first("flush_at").alias("flush_at"),
            F.first("reason").alias("reason"),
            F.sort_array(F.collect_list("item")).alias("items"),
        )
    )
    with_path = join_checked(
        gathered,
        routes.select("route_id", "path"),
        ["route_id"],
        spread=["batch_id"],
        small=small,
    )
    return with_path.select(
        "route_id",
        "path",
        "batch_id",
        "part",
        "flush_at",
        "reason",
        F.size("items").cast("bigint").alias("n_entries"),
        F.transform(
            "items", lambda item: F.struct(F.col("path").alias("path"), item["line"].alias("line"))
        ).alias("entries"),
    )
