"""The size-or-time buffer over written tables.

Buffered lines are kept as files, and the buffer's state is a small table of counts
and clocks, one row per route and micro-batch:

    lines/segment=L-A-B/route_id=R   kept lines of micro-batches A to B by route
    clock/epoch=N                    per route: lines buffered and the segments that
                                     hold them, last flush, decision taken, flush totals

A micro-batch writes a segment of level 0.  ``fan`` segments of a level are merged to
one of the next, without the lines that have been flushed since, so that a route
that stays quiet for a day of polls has some tens of segments and each line is
rewritten a few times at most.  Which segments a route's lines are in stands in its
clock row: nothing is found by listing.  Lines are dealt by route before they
are written, a busy route to several tasks, so that a micro-batch makes about as many
files as routes had lines.

Only the counts decide when to flush.  They are aggregated before the shuffle,
and a batch is gathered by as many tasks as it has parts, so a route that
brings a third of all lines is spread like any other data.  Only the lines of
routes that flush are read, and what a route has flushed is dropped whatever the
others still hold.  A repeated micro-batch finds its decision already written and
takes the same one again; segments go only once no repetition needs them.

:meth:`TableBuffer.pending_lines` and :meth:`TableBuffer.flush_log` read the last
clock of a running or stopped stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.batching import (
    BUFFER_FULL,
    MAX_PART_LINES,
    SLICE_SPAN,
    TIME_ELAPSED,
    part_of,
)
from millrace.session import drop_folder, folder_names, is_small, is_written, join_checked

# Segments of a level that are merged to one of the next.
FAN = 16
# Beyond so many folders of single routes, whole segments are opened.
MOST_PATHS = 4096

LINE_SCHEMA = "segment string, route_id bigint, epoch bigint, offset bigint, line string"
CLOCK_SCHEMA = (
    "route_id bigint, path string, n bigint, last_flush bigint, last_poll bigint, "
    "flushes bigint, first_epoch bigint, segments array<string>, flushed boolean, "
    "reason string, flush_at bigint, n_entries bigint, from_epoch bigint, "
    "from_segments array<string>, full_flushes bigint, full_entries bigint, "
    "full_largest bigint, timed_flushes bigint, timed_entries bigint, timed_largest bigint"
)
# Totals of past flushes by the reason they had.
_TOTALS = {BUFFER_FULL: "full", TIME_ELAPSED: "timed"}
_NO_SEGMENTS = "array<string>"


def _span(segment: str) -> tuple[int, int, int]:
    """Level, first and last micro-batch."""
    level, first, last = segment.split("-")
    return int(level), int(first), int(last)


def _renamed(clock: DataFrame, merged: list[str], name: str) -> DataFrame:
    """The clock with one segment in the place of those that were merged to it."""
    old = F.array(*[F.lit(segment) for segment in merged])
    rest = F.concat(F.array(F.lit(name)), F.array_except("segments", old))
    held = F.arrays_overlap("segments", old)
    return clock.withColumn("segments", F.when(held, rest).otherwise(F.col("segments")))


class TableBuffer:
    """Buffers routed lines below ``work_dir``, which all executors can reach."""

    def __init__(
        self,
        spark: SparkSession,
        routes: DataFrame,
        work_dir: str,
        started_ms: int,
        max_part_lines: int = MAX_PART_LINES,
        slice_span: int = SLICE_SPAN,
        fan: int = FAN,
    ):
        self.spark = spark
        self.routes = routes.select(
            "route_id", "path", "polling_frequency_ms", "buffer_size", "flush_interval_ms"
        )
        self.small = is_small(self.routes)
        self.work_dir = work_dir
        self.started_ms = started_ms
        self.max_part_lines = max_part_lines
        self.slice_span = slice_span
        self.fan = max(2, fan)

    def poll(self, routed: DataFrame, epoch: int, now_ms: int) -> DataFrame | None:
        """Take in one micro-batch; returns the batches it flushes, if any.

        Micro-batches follow the shortest poll period.  A route with a longer
        one only collects its lines until its own next poll is due.
        Nothing is flushed before all lines of the poll are in the buffer, and a
        flush takes the whole buffer of its route.
        """
        if not is_written(self.spark, self._path(f"clock/epoch={epoch}")):
            segment = f"0-{epoch}-{epoch}"
            number = F.lit(epoch).cast("bigint").alias("epoch")
            self._write(routed.select("route_id", number, "offset", "line"), segment)
            before = self._merge(self._clock(epoch - 1))
            self._decide(before, epoch, now_ms, segment).coalesce(1).write.mode(
                "overwrite"
            ).parquet(self._path(f"clock/epoch={epoch}"))
        self._prune(epoch)
        due = self._clock(epoch).filter("flushed")
        return None if due.isEmpty() else self._gather(due)

    def pending_lines(self) -> DataFrame:
        """Lines buffered and not flushed: ``(route_id, epoch, offset, line)``."""
        clock = self._last_clock()
        return self._held(clock, clock).select("route_id", "epoch", "offset", "line")

    def flush_log(self) -> DataFrame:
        """Flushes so far: ``(route_id, reason, n_flushes, n_entries, largest)``."""
        totals = [
            F.struct(
                F.lit(reason).alias("reason"),
                F.col(f"{name}_flushes").alias("n_flushes"),
                F.col(f"{name}_entries").alias("n_entries"),
                F.col(f"{name}_largest").alias("largest"),
            )
            for reason, name in _TOTALS.items()
        ]
        return (
            self._last_clock()
            .select("route_id", F.inline(F.array(*totals)))
            .filter("n_flushes > 0")
        )

    def _merge(self, before: DataFrame) -> DataFrame:
        """Merge the levels that are full; returns the clock with the new segments."""
        levels: dict[int, list[str]] = {}
        # Fewer than ``fan`` of each level, and one level per power of it.
        for row in before.select(F.explode("segments")).distinct().collect():
            levels.setdefault(_span(row[0])[0], []).append(row[0])
        level = 0
        while len(levels.get(level, ())) >= self.fan:
            old = sorted(levels[level], key=_span)
            spans = [_span(segment) for segment in old]
            name = f"{level + 1}-{spans[0][1]}-{max(last for _, _, last in spans)}"
            of_old = before.withColumn(
                "segments", F.array_intersect("segments", F.array(*[F.lit(x) for x in old]))
            )
            self._write(self._held(of_old, before).drop("segment"), name)
            before = _renamed(before, old, name)
            levels.setdefault(level + 1, []).append(name)
            level += 1
        return before

    def _decide(
        self, before: DataFrame, epoch: int, now_ms: int, segment: str
    ) -> DataFrame:
        new = self._read([self._path(f"lines/segment={segment}")])
        fresh = new.groupBy("route_id").agg(F.count(F.lit(1)).alias("fresh"))
        totals = [f"{name}_{what}" for name in _TOTALS.values() for what in ("flushes", "entries", "largest")]
        before = before.select(
            "route_id", F.col("n").alias("kept"), "last_flush", "last_poll", "flushes",
            "first_epoch", "segments", *totals,
        )
        n = F.coalesce("kept", F.lit(0)) + F.coalesce("fresh", F.lit(0))
        full = F.col("n") >= F.col("buffer_size")
        elapsed = F.lit(now_ms) - F.col("last_flush") >= F.col("flush_interval_ms")
        polls = [
            F.call_function("div", moment - self.started_ms, F.col("polling_frequency_ms"))
            for moment in (F.lit(now_ms), F.col("last_poll"))
        ]
        none = F.array().cast(_NO_SEGMENTS)
        own = F.when(F.col("fresh") > 0, F.array(F.lit(segment))).otherwise(none)
        flushed = F.col("flushed")
        emptied = flushed | (F.col("n") == 0)
        state = (
            self.routes.join(before, "route_id", "left")
            .join(fresh, "route_id", "left")
            .withColumn("n", n)
            .withColumn("last_flush", F.coalesce("last_flush", F.lit(self.started_ms)))
            .withColumn("flushes", F.coalesce("flushes", F.lit(0)))
            .withColumn("first_epoch", F.coalesce("first_epoch", F.lit(epoch)))
            .withColumn("segments", F.concat(F.coalesce("segments", none), own))
            .withColumn("last_poll", F.coalesce("last_poll", F.lit(self.started_ms)))
            .withColumn("polled", polls[0] > polls[1])
            .withColumn("flushed", F.col("polled") & (F.col("n") > 0) & (full | elapsed))
            .withColumn("reason", F.when(flushed, F.when(full, BUFFER_FULL).otherwise(TIME_ELAPSED)))
        )
        columns = {
            "route_id": F.col("route_id"),
            "path": F.col("path"),
            "n": F.when(flushed, 0).otherwise(F.col("n")),
            "last_flush": F.when(flushed, now_ms).otherwise(F.col("last_flush")),
            "last_poll": F.when(F.col("polled"), now_ms).otherwise(F.col("last_poll")),
            "flushes": F.col("flushes") + flushed.cast("int"),
            "first_epoch": F.when(emptied, epoch + 1).otherwise(F.col("first_epoch")),
            "segments": F.when(emptied, none).otherwise(F.col("segments")),
            "flushed": flushed,
            "reason": F.col("reason"),
            "flush_at": F.when(flushed, now_ms),
            "n_entries": F.when(flushed, F.col("n")),
            "from_epoch": F.when(flushed, F.col("first_epoch")),
            "from_segments": F.when(flushed, F.col("segments")),
            **self._totals(),
        }
        types = dict(part.split() for part in CLOCK_SCHEMA.split(", "))
        return state.select(*[c.cast(types[name]).alias(name) for name, c in columns.items()])

    def _totals(self) -> dict[str, Column]:
        """Totals of all flushes, this one included."""
        out = {}
        for reason, name in _TOTALS.items():
            mine = F.coalesce(F.col("reason") == reason, F.lit(False))
            flushes, entries, largest = (
                F.coalesce(f"{name}_{what}", F.lit(0)) for what in ("flushes", "entries", "largest")
            )
            size = F.when(mine, F.col("n")).otherwise(0)
            out[f"{name}_flushes"] = flushes + mine.cast("int")
            out[f"{name}_entries"] = entries + size
            out[f"{name}_largest"] = F.greatest(largest, size)
        return out

    def _gather(self, due: DataFrame) -> DataFrame:
        slice_no = F.call_function("div", F.col("offset"), F.lit(self.slice_span))
        flushing = due.select(
            "route_id", "path", F.col("flushes").alias("batch_id"), "flush_at", "reason",
            "n_entries", F.col("from_epoch").alias("first_epoch"),
            F.col("from_segments").alias("segments"),
        )
        buffered = self._held(flushing, flushing.drop("segments"))
        sliced = buffered.withColumn("slice", slice_no)
        if due.filter(F.col("n_entries") > self.max_part_lines).isEmpty():
            parted = sliced.withColumn("part", F.lit(0).cast("bigint"))
        else:
            # Lines per slice, and those before them: a row per slice of what flushes.
            earlier = Window.partitionBy("route_id").orderBy("epoch", "slice")
            counts = sliced.groupBy("route_id", "epoch", "slice").agg(F.count(F.lit(1)).alias("n"))
            before = counts.withColumn("before", F.sum("n").over(earlier) - F.col("n")).drop("n")
            part = part_of(
                F.col("n_entries"), F.col("before"), self.max_part_lines, self.slice_span
            )
            parted = sliced.join(before, ["route_id", "epoch", "slice"]).withColumn(
                "part", part.cast("bigint")
            )
        gathered = (
            parted
            .groupBy("route_id", "batch_id", "part")
            .agg(
                F.first("path").alias("path"),
                F.first("flush_at").alias("flush_at"),
                F.first("reason").alias("reason"),
                F.sort_array(F.collect_list(F.struct("epoch", "offset", "line"))).alias("items"),
            )
        )
        return gathered.select(
            "route_id",
            "path",
            "batch_id",
            "part",
            "flush_at",
            "reason",
            F.size("items").cast("bigint").alias("n_entries"),
            F.transform(
                "items",
                lambda item: F.struct(F.col("path").alias("path"), item["line"].alias("line")),
            ).alias("entries"),
        )

    # -- the tables ------------------------------------------------------------
    def _path(self, name: str) -> str:
        return f"{self.work_dir}/{name}"

    def _write(self, lines: DataFrame, segment: str) -> None:
        # Tasks get routes, small ones together, and a busy route several tasks.
        dealt = lines.hint("rebalance", "route_id").write.mode("overwrite")
        dealt.partitionBy("route_id").parquet(self._path(f"lines/segment={segment}"))

    def _read(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(LINE_SCHEMA).option("basePath", self._path("lines"))
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], LINE_SCHEMA)

    def _held(self, of_routes: DataFrame, clock: DataFrame) -> DataFrame:
        """Lines in the ``segments`` of some routes that have not been flushed, with their clock.

        A folder is opened per route and segment, whatever else lies beside it.
        """
        places = of_routes.select("route_id", F.explode("segments").alias("segment"))
        rows = places.limit(MOST_PATHS + 1).collect()
        folders = [f"segment={r['segment']}/route_id={r['route_id']}" for r in rows]
        if len(rows) > MOST_PATHS:
            folders = [f"segment={r[0]}" for r in places.select("segment").distinct().collect()]
        kept = join_checked(
            self._read([self._path(f"lines/{folder}") for folder in folders]),
            clock if "segments" not in clock.columns else clock.select("route_id", "first_epoch"),
            ["route_id"],
            spread=["epoch", "offset"],
            small=self.small,
        )
        return kept.filter(F.col("epoch") >= F.col("first_epoch")).drop("first_epoch")

    def _clock(self, epoch: int) -> DataFrame:
        if epoch < 0 or not is_written(self.spark, self._path(f"clock/epoch={epoch}")):
            return self.spark.createDataFrame([], CLOCK_SCHEMA)
        return self.spark.read.schema(CLOCK_SCHEMA).parquet(self._path(f"clock/epoch={epoch}"))

    def _last_clock(self) -> DataFrame:
        epochs = sorted((number for _, number in self._clocks()), reverse=True)
        written = (e for e in epochs if is_written(self.spark, self._path(f"clock/epoch={e}")))
        return self._clock(next(written, -1))

    def _clocks(self) -> list[tuple[str, int]]:
        names = [(f, f.partition("=")[2]) for f in folder_names(self.spark, self._path("clock"))]
        return [(f, int(n)) for f, n in names if f.startswith("epoch=") and n.isdigit()]

    def _prune(self, epoch: int) -> None:
        """Drop segments without lines that are still held, flushed routes, and old clocks.

        What a repetition of this micro-batch reads stays.
        """
        held = F.concat("segments", F.coalesce("from_segments", F.array().cast(_NO_SEGMENTS)))
        live = self._clock(epoch).select(F.explode(held)).distinct().collect()
        kept = {f"segment={row[0]}" for row in live}
        for folder in folder_names(self.spark, self._path("lines")):
            if folder not in kept:
                drop_folder(self.spark, self._path(f"lines/{folder}"))
        # A flush takes all its route has in these segments: one row per route and segment.
        flushed = self._clock(epoch - 1).filter("flushed")
        for row in flushed.select("route_id", F.explode("from_segments").alias("segment")).collect():
            if f"segment={row['segment']}" in kept:
                folder = f"lines/segment={row['segment']}/route_id={row['route_id']}"
                drop_folder(self.spark, self._path(folder))
        for folder, number in self._clocks():
            if number < epoch - 1:
                drop_folder(self.spark, self._path(f"clock/{folder}"))
