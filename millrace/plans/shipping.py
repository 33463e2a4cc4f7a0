"""From a line table and a routes table to batches, requests and outcomes."""

from __future__ import annotations

import socket

from pyspark.sql import Column, DataFrame, SparkSession

from millrace.functions.encoding import DEFAULT_TAG
from millrace.operators.batching import (
    CHUNK_TICKS,
    MAX_PART_LINES,
    SLICE_SPAN,
    batch_lines,
    collect_batches,
)
from millrace.operators.routing import ship_lines
from millrace.plans.routes import ready_routes
from millrace.session import is_small, is_written
from millrace.sinks.delivery import Transport, deliver
from millrace.sinks.files import prepare_file_routes, write_file_routes
from millrace.sinks.requests import build_requests
from millrace.sources.text import split_valid


def plan_batches(
    lines: DataFrame,
    routes: DataFrame,
    horizon_ms: int | None = None,
    slice_span: int = SLICE_SPAN,
    chunk_ticks: int = CHUNK_TICKS,
    max_part_lines: int = MAX_PART_LINES,
) -> DataFrame:
    """Route, filter and batch ``lines(path, offset, arrival_us, line)``."""
    small = is_small(routes)
    routed = ship_lines(lines, routes, small)
    assigned = batch_lines(routed, routes, horizon_ms, slice_span, chunk_ticks, small)
    return collect_batches(assigned, routes, max_part_lines, small, slice_span)


def ship_table(
    spark: SparkSession,
    lines: DataFrame,
    routes: DataFrame,
    transport: Transport,
    work_dir: str,
    horizon_ms: int | None = None,
    ship_ts: Column | None = None,
    on_failure: str = "drop",
    host: str | None = None,
    tag: str = DEFAULT_TAG,
    zone: str = "UTC",
    ordered: bool = False,
) -> DataFrame:
    """Ship a whole line table; returns the outcomes of the network requests.

    Lines that are not valid UTF-8 are set aside in ``work_dir/quarantine``.
    ``host`` (default: this machine's name), ``tag`` and ``zone`` go into syslog
    messages.  ``ordered`` sends the batches of a route one after the other.

    The batches are written once below ``work_dir``, which both the file routes
    and the network requests then read.  A job that was interrupted can be
    repeated with the same ``work_dir``: it finds the finished batches and goes
    on with what has not been delivered yet.
    """
    ready = ready_routes(spark, routes)
    prepare_file_routes(spark, ready)
    batches_path = f"{work_dir}/batches"
    usable, rest = split_valid(lines)
    if not is_written(spark, f"{work_dir}/quarantine"):
        rest.write.mode("overwrite").parquet(f"{work_dir}/quarantine")
    batches = plan_batches(usable, ready, horizon_ms)
    if not is_written(spark, batches_path):
        batches.write.mode("overwrite").partitionBy("route_id").parquet(batches_path)
    stored = spark.read.schema(batches.schema).parquet(batches_path)
    write_file_routes(stored, ready, f"{work_dir}/files")
    host = socket.gethostname() if host is None else host
    network = ready.filter("destination.type <> 'file'")
    requests = build_requests(stored, network, ship_ts, host, tag, zone)
    return deliver(spark, requests, transport, f"{work_dir}/outcomes", on_failure, ordered=ordered)
