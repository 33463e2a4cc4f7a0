"""Run routes continuously: tail, filter, buffer, deliver."""

from __future__ import annotations

import hashlib
import socket
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.encoding import DEFAULT_TAG
from millrace.operators.batching import MAX_PART_LINES
from millrace.operators.routing import ship_lines
from millrace.plans.routes import ready_routes
from millrace.sinks.delivery import Transport, deliver
from millrace.sinks.files import prepare_file_routes, write_file_routes
from millrace.sinks.requests import build_requests, request_url
from millrace.sources.tail import SOURCE_NAME, last_offset, register, tail_options
from millrace.streaming.buffer import SET_ASIDE, STATE_PROVIDER, BufferSettings, buffer_stream
from millrace.streaming.table_buffer import TableBuffer

# Why a line or range was set aside.
INVALID_UTF8 = "invalid UTF-8"
LOST_RANGE = "lost range"

_PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS_CONF = "spark.sql.shuffle.partitions"
_POOL = "spark.scheduler.pool"


def tail_lines(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Stream ``(path, inode, offset, arrival, line)`` of growing files.

    Lines are text with the bytes they have, and ``lost`` marks what could not
    be read; see ``split_usable``.  A poll takes all that is new unless
    ``maxBytesPerTrigger`` says otherwise.
    """
    register(spark)
    raw = spark.readStream.format(SOURCE_NAME).options(**tail_options(paths, **options)).load()
    return raw.withColumn("line", F.col("line").cast("string"))


def read_tail(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """The same rows for whole files, as a batch."""
    register(spark)
    raw = spark.read.format(SOURCE_NAME).options(**tail_options(paths, **options)).load()
    return raw.withColumn("line", F.col("line").cast("string"))


def split_usable(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines to ship, and ``(path, inode, offset, line, lost, reason)`` of the rest.

    The rest are lines that are not valid UTF-8, as bytes, and ranges that
    could not be read.
    """
    usable = F.coalesce(F.is_valid_utf8("line"), F.lit(False)) & F.col("lost").isNull()
    reason = F.when(F.col("lost").isNotNull(), LOST_RANGE).otherwise(INVALID_UTF8)
    rest = lines.filter(~usable).select(
        "path", "inode", "offset", F.col("line").cast("binary").alias("line"), "lost",
        reason.alias("reason"),
    )
    return lines.filter(usable).drop("lost"), rest


def buffer_settings(routes: DataFrame) -> dict[int, BufferSettings]:
    """Per-route settings for the stateful operator: four values per route."""
    rows = (
        routes.select(
            "route_id", "path", "polling_frequency_ms", "buffer_size", "flush_interval_ms"
        )
        .collect()
    )
    return {r["route_id"]: BufferSettings(*r[1:]) for r in rows}


def stream_batches(
    lines: DataFrame,
    routes: DataFrame,
    started_ms: int | None = None,
    max_part_lines: int = MAX_PART_LINES,
) -> DataFrame:
    """Route, filter and buffer a stream of lines.

    What cannot be shipped comes out at once under route ``SET_ASIDE``, its
    lines in hexadecimal digits.
    """
    started_ms = _now_ms() if started_ms is None else started_ms
    usable, rest = split_usable(lines)
    routed = ship_lines(usable, routes).select("route_id", "path", "offset", "line")
    aside = rest.select(
        F.lit(SET_ASIDE).cast("bigint").alias("route_id"),
        "path",
        "offset",
        F.coalesce(F.hex("line"), F.concat(F.lit(f"{LOST_RANGE}: "), F.col("lost"))).alias("line"),
    )
    return buffer_stream(
        routed.unionByName(aside), buffer_settings(routes), started_ms, max_part_lines
    )


def poll_period_ms(routes: DataFrame) -> int:
    """Trigger period that serves every route: the shortest poll period."""
    return routes.agg(F.min("polling_frequency_ms")).first()[0]


def start_shipping(
    spark: SparkSession,
    routes: DataFrame,
    work_dir: str,
    transport: Transport,
    buffer: str = "table",
    on_failure: str = "drop",
    ship_ts: Column | None = None,
    max_part_lines: int = MAX_PART_LINES,
    trigger: dict | None = None,
    host: str | None = None,
    tag: str = DEFAULT_TAG,
    zone: str = "UTC",
    ordered: bool = False,
    sending_tasks: int | None = None,
    **source_options,
) -> StreamingQuery:
    """Start one query for all valid routes.

    ``buffer='table'`` keeps buffered lines in written tables and spreads a busy
    route over many tasks.  ``buffer='state'`` keeps them in the state store,
    one task per route: less to write per poll, for many quiet routes.

    Flushed batches of a micro-batch are written to ``work_dir/batches/epoch=N``
    before anything is sent, so a repeated micro-batch replaces them.  The
    outcomes of the requests follow in ``work_dir/outcomes/epoch=N``, and a
    repeated micro-batch does not send requests again that have one.  Lines that
    are not valid UTF-8, and ranges of files that could not be read, are set aside
    in ``work_dir/quarantine/epoch=N``.  A restart goes on from the checkpoint, which
    like everything in ``work_dir`` may be on any file system that Spark can use.

    ``host`` (default: this machine's name), ``tag`` and ``zone`` go into syslog
    messages.  ``ordered`` sends the batches of a route one after the other, and
    no more than ``sending_tasks`` tasks send at a time.

    A micro-batch ends when all its requests have been answered, so a slow
    destination delays every route of the query; see :func:`start_isolated`.
    """
    if buffer not in ("table", "state"):
        raise ValueError("buffer must be 'table' or 'state'")
    ready = ready_routes(spark, routes)
    prepare_file_routes(spark, ready)
    network = ready.filter("destination.type <> 'file'")
    paths = [r["path"] for r in ready.select("path").distinct().collect()]
    host = socket.gethostname() if host is None else host
    planned = last_offset(spark, f"{work_dir}/checkpoint")
    if planned is not None:
        source_options.setdefault("startCursor", planned)
    source_options.setdefault("heartbeat", buffer == "table")
    lines = tail_lines(spark, paths, **source_options)

    def set_aside(rest: DataFrame, epoch: int) -> None:
        if not rest.isEmpty():
            rest.write.mode("overwrite").parquet(f"{work_dir}/quarantine/epoch={epoch}")

    def ship(flushed: DataFrame, epoch: int) -> None:
        table = f"{work_dir}/batches/epoch={epoch}"
        flushed.write.mode("overwrite").partitionBy("route_id").parquet(table)
        stored = spark.read.schema(flushed.schema).parquet(table)
        if stored.isEmpty():
            return
        requests = build_requests(stored, network, ship_ts, host, tag, zone)
        outcomes = f"{work_dir}/outcomes/epoch={epoch}"
        deliver(
            spark, requests, transport, outcomes, on_failure,
            ordered=ordered, sending_tasks=sending_tasks,
        )
        write_file_routes(stored, ready, f"{work_dir}/files/epoch={epoch}")

    if buffer == "state":
        output = stream_batches(lines, ready, max_part_lines=max_part_lines)

        def handle(flushed: DataFrame, epoch: int) -> None:
            flushed.persist()
            aside = flushed.filter(F.col("route_id") == SET_ASIDE)
            entry = aside.select(F.explode("entries").alias("entry")).select("entry.*")
            set_aside(entry, epoch)
            ship(flushed.filter(F.col("route_id") != SET_ASIDE), epoch)
            flushed.unpersist()

    else:
        output = lines
        tables = TableBuffer(spark, ready, f"{work_dir}/buffer", _now_ms(), max_part_lines)

        def handle(polled: DataFrame, epoch: int) -> None:
            polled.persist()
            usable, rest = split_usable(polled)
            set_aside(rest, epoch)
            flushed = tables.poll(ship_lines(usable, ready), epoch, _now_ms())
            if flushed is not None:
                ship(flushed, epoch)
            polled.unpersist()

    writer = (
        output.writeStream.foreachBatch(handle)
        .outputMode("append")
        .option("checkpointLocation", f"{work_dir}/checkpoint")
        .trigger(**(trigger or {"processingTime": f"{poll_period_ms(ready)} milliseconds"}))
    )
    if buffer == "state":
        return start_with_state(spark, writer, ready.count())
    return writer.start()


def destination_group(destination: Column) -> Column:
    """What routes share that wait for each other: a host and port, or the file store."""
    url = request_url(destination)
    place = F.lower(F.regexp_extract(url, r"^([^:/?#]+://)(?:[^/?#@]*@)?([^/?#]*)", 2))
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]+://)", 1))
    return F.when(destination["type"] == "file", F.lit("file")).otherwise(F.concat(scheme, place))


def start_isolated(
    spark: SparkSession,
    routes: DataFrame,
    work_dir: str,
    transport: Transport,
    sending_tasks: int | None = None,
    **options,
) -> dict[str, StreamingQuery]:
    """Start a query for each destination; returns them by destination group.

    A destination that is slow or does not answer delays its own routes only.
    Each query has its own work folder ``work_dir/group=…``, with checkpoint,
    buffer, batches and outcomes, named by its destination alone, so that other
    destinations come and go without touching it.  It tails the files of its
    routes itself: a file that goes to two destinations is read at the pace of
    each, and a stalled one holds nothing back and nothing in memory.

    Queries run in scheduler pools of their own (fair where the session sets
    ``spark.scheduler.mode`` to ``FAIR``).  At most ``sending_tasks`` tasks of a
    query send at a time, by default so many that all queries together leave
    half of the cores free, and one at least.  Queries beyond the cores of a
    session still wait for each other.

    ``options`` are those of :func:`start_shipping`.
    """
    ready = ready_routes(spark, routes).withColumn("_group", destination_group(F.col("destination")))
    groups = sorted(row[0] for row in ready.select("_group").distinct().collect())
    context = spark.sparkContext
    if sending_tasks is None:
        sending_tasks = max(1, context.defaultParallelism // (2 * max(1, len(groups))))
    before = context.getLocalProperty(_POOL)
    queries: dict[str, StreamingQuery] = {}
    try:
        for group in groups:
            name = group_folder(group)
            context.setLocalProperty(_POOL, name)
            queries[group] = start_shipping(
                spark,
                ready.filter(F.col("_group") == group).drop("_group"),
                f"{work_dir}/group={name}",
                transport,
                sending_tasks=sending_tasks,
                **options,
            )
    except BaseException:
        for query in queries.values():
            query.stop()
        raise
    finally:
        context.setLocalProperty(_POOL, before)
    return queries


def group_folder(group: str) -> str:
    """Folder name of a destination group; any text may stand in an address."""
    return hashlib.sha256(group.encode()).hexdigest()[:16]


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


def start_with_state(spark: SparkSession, writer, keys: int) -> StreamingQuery:
    """Start a stateful query with the RocksDB state store it needs.

    ``keys`` is the number of routes: more state partitions than that would
    only add stores to commit in every micro-batch.
    """
    partitions = min(int(spark.conf.get(_PARTITIONS_CONF)), max(1, keys))
    wanted = {_PROVIDER_CONF: STATE_PROVIDER, _PARTITIONS_CONF: str(partitions)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
