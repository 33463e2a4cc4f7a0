"""One query per operator, each over whole given tables."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import encoding as E
from millrace.functions.predicates import java_patterns
from millrace.operators import batching as B
from millrace.operators.routing import allow_lines, deny_lines, route_lines, ship_lines
from millrace.operators.selection import (
    passthrough_flag,
    select_lines,
    ship_accounting,
    to_entries,
)
from millrace.plans.routes import has_auth, normalize_routes, validate_routes
from millrace.plans.shipping import plan_batches, ship_table
from millrace.queries.tables import (
    HORIZON_MS,
    ORIGIN,
    document_files,
    document_lines,
    event_lines,
    event_routes,
    listing_and_cursor,
    read,
    supplier_routes,
)
from millrace.session import is_written, make_folder, move_files, scratch_dir
from millrace.sinks.delivery import check_bulk_response, deliver
from millrace.sinks.files import prepare_file_routes, write_entries, write_file_routes
from millrace.sinks.requests import build_requests, decode_payload, request_headers
from millrace.sources.scan import advance_cursor, plan_scan, resume_lines
from millrace.sources.text import flag_invalid, read_lines
from millrace.streaming.buffer import BATCH_SCHEMA, BufferSettings, buffer_stream
from millrace.streaming.ship import buffer_settings, read_tail, start_with_state, tail_lines
from millrace.streaming.table_buffer import TableBuffer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing underscore avoids a clash."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# -- scans --------------------------------------------------------------------


@query
def frame_lines_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir)


@query
def scan_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines written as text files and scanned back by the built-in reader."""
    folder = _written_lines(spark, sf_dir)
    return read_lines(spark, folder).select(_log_path(F.col("path")).alias("path"), "line")


@query
def scan_tail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through the tail source, in small byte ranges."""
    files = spark.read.text(_written_lines(spark, sf_dir)).inputFiles()
    rows = read_tail(spark, files, partitionBytes=256 * 1024)
    return rows.select(_log_path(F.col("path")).alias("path"), "line")


@query
def scan_tail_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in three reads by offset, each of which opens its byte ranges only."""
    files = spark.read.text(_written_lines(spark, sf_dir)).inputFiles()
    begin, middle, end = (
        read_tail(spark, files, partitionBytes=256 * 1024, **bounds)
        for bounds in (
            {"untilOffset": 10_000},
            {"fromOffset": 10_000, "untilOffset": 50_000},
            {"fromOffset": 50_000},
        )
    )
    ranges = begin.unionByName(middle).unionByName(end)
    return ranges.select(_log_path(F.col("path")).alias("path"), "line")


@query
def utf8_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of every seventh document get a byte that is not UTF-8."""
    broken = (F.col("line_no") == 0) & (F.col("doc_id") % 7 == 0)
    data = F.encode("line", "UTF-8")
    lines = document_lines(spark, sf_dir).withColumn(
        "line", F.when(broken, F.concat(data, F.unhex(F.lit("FF")))).otherwise(data).cast("string")
    )
    return flag_invalid(lines).select(
        "doc_id",
        "line_no",
        "quarantined",
        F.octet_length("line").cast("bigint").alias("n_bytes"),
    )


@query
def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_scan(*listing_and_cursor(document_files(spark, sf_dir)))


@query
def scan_plan_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_scan(*listing_and_cursor(document_files(spark, sf_dir)), from_start=True)


@query
def advance_cursor_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advance_cursor(scan_plan(spark, sf_dir))


@query
def resume_lines_(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return resume_lines(files.select("path", "text"), plan_scan(*listing_and_cursor(files)))


# -- selection ----------------------------------------------------------------


def _selected(spark: SparkSession, sf_dir: str, match_on=(), exclude_on=()) -> DataFrame:
    return select_lines(event_lines(spark, sf_dir), match_on, exclude_on).select(
        "path", "offset", "line"
    )


@query
def match_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, ["ERROR", "WARN"])


@query
def exclude_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, exclude_on=["DEBUG", "TRACE"])


@query
def match_and_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, ["ERROR", "WARN"], [r"\[test\]", r"\[dev\]"])


@query
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir)


@query
def regex_timestamp_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [r"^\[20\d\d-\d\d-\d\d ", "EVT-[0-9]{4}"]
    return _selected(spark, sf_dir, patterns, ["EVT-1001", "error.*test"])


@query
def regex_counted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, [r"took [1-9]\d{3,}ms"])


@query
def regex_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups, flags, POSIX classes and alternation over document lines."""
    patterns = [r"(?P<first>[[:upper:]]{2,})\s+\d+$", r"(?i)\b(error|license|password)\b"]
    return select_lines(document_lines(spark, sf_dir), patterns, [r"[[:punct:]]{3}", "^$"]).select(
        "doc_id", "line_no", "line"
    )


@query
def ship_accounting_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship_accounting(event_lines(spark, sf_dir), ["ERROR", "WARN"], [r"\[test\]"])


@query
def entry_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that leaves the system, for every kept line of every route."""
    return to_entries(ship_lines(event_lines(spark, sf_dir), event_routes(spark)))


# -- routing ------------------------------------------------------------------


@query
def route_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_lines(event_lines(spark, sf_dir), event_routes(spark)).select(
        "route_id", "path", "offset"
    )


@query
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship_lines(event_lines(spark, sf_dir), event_routes(spark)).select(
        "route_id", "path", "offset", "line"
    )


def _rule_table(spark: SparkSession, column: str) -> DataFrame:
    return event_routes(spark).select(
        "route_id", F.explode(java_patterns(column)).alias("pattern")
    )


@query
def allow_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = event_routes(spark)
    routed = route_lines(event_lines(spark, sf_dir), routes)
    return allow_lines(routed, _rule_table(spark, "match_on"), routes).select(
        "route_id", "offset", "line"
    )


@query
def deny_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_lines(event_lines(spark, sf_dir), event_routes(spark))
    return deny_lines(routed, _rule_table(spark, "exclude_on")).select(
        "route_id", "offset", "line"
    )


# -- batching -----------------------------------------------------------------


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship_lines(event_lines(spark, sf_dir), event_routes(spark))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tick_counts(B.tick_slices(B.with_ticks(_routed(spark, sf_dir))))


@query
def tick_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(spark, sf_dir)


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Short chunks, so that every route crosses several of them.
    return B.fold_ticks(_ticks(spark, sf_dir), event_routes(spark), HORIZON_MS, chunk_ticks=4096)


@query
def flush_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.flush_schedule(_folded(spark, sf_dir))


@query
def flush_schedule_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with routes of which every other flushes by size only."""
    endless = F.when(F.col("route_id") % 2 == 1, F.lit(2**62)).otherwise(F.col("flush_interval_ms"))
    routes = event_routes(spark).withColumn("flush_interval_ms", endless)
    ticks = B.tick_counts(B.tick_slices(B.with_ticks(_routed(spark, sf_dir))))
    return B.flush_schedule(B.fold_ticks(ticks, routes, HORIZON_MS))


@query
def flush_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.flush_log(flush_schedule(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batch_lines(_routed(spark, sf_dir), event_routes(spark), HORIZON_MS)


@query
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select(
        "route_id", "offset", "tick", "batch_id", "flush_at", "n_entries", "reason"
    )


@query
def pending_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pending_lines(_assigned(spark, sf_dir)).select("route_id", "offset", "line")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_batches(event_lines(spark, sf_dir), event_routes(spark), HORIZON_MS)


@query
def batch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select(
        "route_id", "batch_id", F.posexplode("entries").alias("pos", "entry")
    ).select(
        "route_id",
        "batch_id",
        F.col("pos").cast("bigint").alias("pos"),
        "entry.path",
        "entry.line",
    )


@query
def burst_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines arrive within one poll: one batch per route, cut into parts."""
    burst = event_lines(spark, sf_dir).withColumn("arrival_us", F.lit(1).cast("bigint"))
    batches = plan_batches(
        burst, event_routes(spark), HORIZON_MS, slice_span=100, max_part_lines=500
    )
    return batches.select(
        "route_id",
        "batch_id",
        "part",
        "flush_at",
        "reason",
        "n_entries",
        F.element_at("entries", 1)["line"].alias("first_line"),
        F.element_at("entries", -1)["line"].alias("last_line"),
    )


# -- encoders -----------------------------------------------------------------


def _micros_after_origin(micros: Column) -> Column:
    return F.lit(ORIGIN).cast("timestamp_ntz") + F.make_dt_interval(
        secs=(micros.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(
            "decimal(18,6)"
        )
    )


def _ship_ts() -> Column:
    """A send time per batch with 0, 3 or 6 fractional digits."""
    return _micros_after_origin(F.col("flush_at") * 1000 + F.col("batch_id") * 500)


@query
def http_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select(
        "route_id", "batch_id", "n_entries", E.http_payload(F.col("entries")).alias("payload")
    )


@query
def ship_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to encoded batches, end to end."""
    return _batches(spark, sf_dir).select(
        "route_id",
        "batch_id",
        "flush_at",
        "reason",
        "n_entries",
        E.http_payload(F.col("entries")).alias("payload"),
    )


@query
def bulk_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select(
        "route_id",
        "batch_id",
        E.bulk_body(F.col("entries"), F.lit("logs-app"), _ship_ts()).alias("body"),
    )


@query
def bulk_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("http://"), "c_name", F.repeat(F.lit("/"), F.col("c_nationkey") % 4))
    return read(spark, sf_dir, "customer").select("c_custkey", E.bulk_url(url).alias("url"))


@query
def syslog_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = E.syslog_message(
        F.col("path"), F.col("line"), F.col("ts"), host=F.lit("web-1"), tag="shipper"
    )
    return event_lines(spark, sf_dir).select("offset", message.alias("message"))


@query
def syslog_tcp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = E.syslog_messages(F.col("entries"), _ship_ts(), host=F.lit("web-1"), tag="shipper")
    return _batches(spark, sf_dir).select(
        "route_id", "batch_id", E.tcp_frame(messages).alias("frame")
    )


@query
def syslog_udp_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = E.syslog_messages(F.col("entries"), _ship_ts(), tag="shipper")
    return _batches(spark, sf_dir).select(
        "route_id", "batch_id", F.posexplode(messages).alias("seq", "payload")
    ).withColumn("seq", F.col("seq").cast("bigint"))


@query
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(
        "offset", E.jsonl_record(F.col("path"), F.col("line")).alias("record")
    )


@query
def auth_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    secret = F.concat_ws("-", "c_name", "c_mktsegment", F.repeat("c_name", 4))
    basic = F.when(key != 2, F.struct(F.col("c_name").alias("username"), secret.alias("password")))
    api_key = F.when(key == 0, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", E.authorization(api_key, basic).alias("header")
    )


@query
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_payload(
        http_payload(spark, sf_dir), "payload", ["route_id", "batch_id"]
    ).drop("error")


@query
def decode_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, single objects, missing members, and broken or empty bodies."""
    kind, text = F.col("event_id") % 7, F.col("props")
    body = (
        F.when(kind == 0, F.to_json(F.array(F.struct(text.alias("line")))))
        .when(kind == 1, F.to_json(F.struct(text.alias("path"), text.alias("line"))))
        .when(kind == 2, F.to_json(F.array(F.struct(text.alias("path")), F.struct(text.alias("path")))))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, F.concat(text, F.lit("}")))
        .when(kind == 5, F.lit("[]"))
        .otherwise(text)
    )
    events = read(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return decode_payload(events, "body", ["event_id"])


# -- routes -------------------------------------------------------------------


@query
def normalize_routes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = normalize_routes(supplier_routes(spark, sf_dir))
    return routes.select(
        "route_id",
        "path",
        "polling_frequency_ms",
        "buffer_size",
        "flush_interval_ms",
        F.array_join("match_on", "|").alias("match_on"),
        F.array_join("exclude_on", "|").alias("exclude_on"),
        F.col("destination.require_auth").alias("require_auth"),
        F.col("destination.port").alias("port"),
        F.col("destination.protocol").alias("protocol"),
    )


@query
def validate_routes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = validate_routes(normalize_routes(supplier_routes(spark, sf_dir)))
    return routes.select("route_id", "valid", "error", "warning")


@query
def route_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a route has credentials and whether it filters nothing."""
    return normalize_routes(supplier_routes(spark, sf_dir)).select(
        "route_id",
        F.coalesce(has_auth(F.col("destination")), F.lit(False)).alias("has_auth"),
        passthrough_flag(F.col("match_on"), F.col("exclude_on")).alias("is_passthrough"),
    )


# -- delivery -----------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_requests(
        _batches(spark, sf_dir), event_routes(spark), _ship_ts(), host="web-1", tag="shipper"
    )


@query
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch encoded for the destination type of its route."""
    return _requests(spark, sf_dir).select(
        "request_id",
        "type",
        "url",
        F.size("payloads").cast("bigint").alias("n_payloads"),
        F.array_join("payloads", "\n").alias("payload"),
    )


@query
def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The POST requests of the HTTP and bulk destinations, headers included."""
    requests = _requests(spark, sf_dir).filter(F.col("type").isin("http", "elasticsearch"))
    return requests.select(
        "request_id",
        "url",
        F.col("headers")["Content-Type"].alias("content_type"),
        F.col("headers")["Authorization"].alias("authorization"),
        F.element_at("payloads", 1).alias("body"),
    )


@query
def request_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of each supplier route's requests, one row per header."""
    routes = normalize_routes(supplier_routes(spark, sf_dir))
    return routes.select(
        "route_id", F.explode(request_headers(F.col("destination"))).alias("name", "value")
    )


def fake_transport(request: dict, payload: str) -> tuple[int, str]:
    """Answers by batch number: no network is involved."""
    batch = request["batch_id"]
    if request["type"] == "syslog":
        if batch % 4 == 0:
            raise ConnectionRefusedError("refused")
        return 200, ""
    if batch % 5 == 0:
        return 500, "down"
    if request["type"] == "elasticsearch" and batch % 7 == 0:
        return 200, '{"errors": true}'
    return 201, '{"errors": "true"}'


@query
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = _requests(spark, sf_dir).filter("type <> 'file'")
    outcomes = deliver(spark, network, fake_transport, scratch_dir(spark, "outcomes"))
    return outcomes.select("request_id", "n_entries", "ok", "status", "error")


@query
def bulk_response_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 8
    body = (
        F.when(kind == 0, F.lit("{}"))
        .when(kind == 1, F.lit('{"errors":false}'))
        .when(kind == 2, F.lit('{"errors":"true"}'))
        .when(kind == 3, F.lit("nope"))
        .when(kind == 4, F.lit('{"took":3,"errors":true}'))
        .when(kind == 5, F.lit('{"errors":null}'))
        .otherwise(F.col("props"))
    )
    status = F.when(F.col("user_id") % 10 == 3, 503).otherwise(200)
    responses = read(spark, sf_dir, "events").select(
        "event_id", status.alias("status"), body.alias("body")
    )
    return check_bulk_response(responses).select("event_id", "ok", "error")


@query
def file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_dir(spark, "jsonl")
    write_entries(match_and_exclude(spark, sf_dir), target)
    return spark.read.schema("path string, line string").json(target)


# -- whole jobs ---------------------------------------------------------------


def _shipped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The batch job over all event lines: its outcomes and its work folder.

    One line in eleven has a byte that is not UTF-8 put behind it first.
    """
    work = scratch_dir(spark, "shipped")
    target = F.when(F.col("destination.type") == "file", F.lit(f"{work}/target"))
    routes = event_routes(spark).withColumn(
        "destination", F.col("destination").withField("path", target)
    )
    broken = F.concat(F.encode("line", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    lines = event_lines(spark, sf_dir).withColumn(
        "line", F.when(F.col("offset") % 11 == 3, broken).otherwise(F.col("line"))
    )
    return ship_table(spark, lines, routes, fake_transport, work, HORIZON_MS, _ship_ts()), work


@query
def ship_table_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, _ = _shipped(spark, sf_dir)
    return outcomes.select("request_id", "n_entries", "ok", "status", "error")


@query
def ship_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file routes of the job wrote."""
    _, work = _shipped(spark, sf_dir)
    return spark.read.schema("path string, line string").json(f"{work}/target")


@query
def file_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route appends to a target of its own, in one job; a replay appends nothing."""
    work = scratch_dir(spark, "targets")
    destination = F.col("destination").withField("type", F.lit("file"))
    target = F.concat(F.lit(f"{work}/out/target="), F.col("route_id").cast("string"))
    routes = event_routes(spark).withColumn("destination", destination.withField("path", target))
    batches = plan_batches(event_lines(spark, sf_dir), routes, HORIZON_MS)
    batches.write.partitionBy("route_id").parquet(f"{work}/batches")
    stored = spark.read.schema(batches.schema).parquet(f"{work}/batches")
    prepare_file_routes(spark, routes)
    for _ in range(2):
        write_file_routes(stored, routes, f"{work}/log")
    read_back = spark.read.schema("path string, line string, target bigint").json(f"{work}/out")
    return read_back.withColumnRenamed("target", "route_id")


@query
def ship_table_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job set aside."""
    _, work = _shipped(spark, sf_dir)
    rest = spark.read.parquet(f"{work}/quarantine")
    return rest.select("path", "offset", F.octet_length("line").cast("bigint").alias("n_bytes"))


# -- streams ------------------------------------------------------------------


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    """Event lines as text files, one folder per path."""
    folder = scratch_dir(spark, "lines")
    event_lines(spark, sf_dir).select("path", "line").write.partitionBy("path").text(folder)
    return folder


def _log_path(file: Column) -> Column:
    """The log path a written file stands for."""
    name = F.regexp_extract(file, "path=([^/]*)/", 1)
    return F.url_decode(F.url_decode(name))


@query
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail the event files from the start, in byte-limited micro-batches."""
    files = spark.read.text(_written_lines(spark, sf_dir)).inputFiles()
    out = scratch_dir(spark, "tailed")
    lines = tail_lines(spark, files, startingOffsets="earliest", partitionBytes=1 << 20)
    writer = lines.select(_log_path(F.col("path")).alias("path"), "line").writeStream
    stream = (
        writer.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .start(f"{out}/data")
    )
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.schema("path string, line string").parquet(f"{out}/data")


# Stream queries poll with a tenth of the horizon, until every line has arrived.
STREAM_PERIOD_MS = HORIZON_MS // 10
STREAM_INTERVAL_MS = 600_000_000
STREAM_SCHEMA = "route_id bigint, offset bigint, line string"


def _line_polls(spark: SparkSession, sf_dir: str, folder: str) -> tuple[DataFrame, int]:
    """Routed event lines, staged by the virtual poll that sees them, and the number of polls.

    What was there before the first poll comes with it.
    """
    routed = ship_lines(event_lines(spark, sf_dir), event_routes(spark))
    arrival = F.greatest(F.col("arrival_us"), F.lit(1))
    polled = routed.select(
        "route_id",
        "offset",
        "line",
        F.call_function("div", arrival - 1, F.lit(1000 * STREAM_PERIOD_MS)).alias("poll"),
    )
    polled.write.partitionBy("poll").parquet(f"{folder}/staged")
    staged = spark.read.schema(f"{STREAM_SCHEMA}, poll bigint").parquet(f"{folder}/staged")
    make_folder(spark, f"{folder}/lines")
    return staged, max(HORIZON_MS // STREAM_PERIOD_MS, 1 + (staged.agg(F.max("poll")).first()[0] or 0))


def _arrive(spark: SparkSession, folder: str, poll: int) -> None:
    """The lines of a poll arrive: whole files, as many as there are."""
    move_files(spark, f"{folder}/staged/poll={poll}", f"{folder}/lines", f"poll-{poll}")


@query
def stream_dual_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful buffer over a stream of routed lines.

    When it flushes depends on the clock.  What must hold at any speed: every
    line in one batch of its route, several batches, numbers without gaps, and
    "buffer full" for those that reach the size and for no others.
    """
    out, size = scratch_dir(spark, "buffered"), 20
    staged, n_polls = _line_polls(spark, sf_dir, out)
    n_lines = staged.count()
    lines = spark.readStream.schema(STREAM_SCHEMA).parquet(f"{out}/lines")
    settings = {
        route_id: BufferSettings(s.path, 100, size, 500)
        for route_id, s in buffer_settings(event_routes(spark)).items()
    }
    stream = start_with_state(
        spark,
        buffer_stream(lines, settings, started_ms=0)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(processingTime="200 milliseconds")
        .option("path", f"{out}/batches"),
        keys=len(settings),
    )
    try:
        for poll in range(n_polls):
            _arrive(spark, out, poll)
            time.sleep(0.5)
        _await_lines(stream, f"{out}/batches", n_lines)
    finally:
        stream.stop()
    batches = spark.read.schema(BATCH_SCHEMA).parquet(f"{out}/batches")
    full = (F.col("reason") == "buffer full") == (F.col("n_entries") >= size)
    checks = batches.groupBy("route_id").agg(
        (F.count(F.lit(1)) > 1).alias("several"),
        (F.max("batch_id") == F.countDistinct("batch_id")).alias("gapless"),
        F.bool_and(full).alias("reasons_right"),
    )
    entries = batches.select("route_id", "path", F.explode("entries").alias("entry"))
    totals = entries.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("entry.path") == F.col("path")).alias("n_labelled"),
        F.countDistinct("entry.line").alias("n_distinct"),
        F.sum(F.octet_length("entry.line")).cast("bigint").alias("n_bytes"),
    )
    return totals.join(checks, "route_id")


def _table_buffered(spark: SparkSession, sf_dir: str) -> tuple[TableBuffer, str]:
    """All lines through the buffer over written tables, one micro-batch per virtual poll.

    Gives the buffer of the stopped stream and the folder of its batches.
    """
    out = scratch_dir(spark, "tabled")
    _, n_polls = _line_polls(spark, sf_dir, out)
    lines = spark.readStream.schema(STREAM_SCHEMA).parquet(f"{out}/lines")
    routes = event_routes(spark).withColumns(
        {
            "polling_frequency_ms": F.lit(STREAM_PERIOD_MS).cast("bigint"),
            "buffer_size": (150 * (1 + F.col("route_id") % 4)).cast("bigint"),
            "flush_interval_ms": F.lit(STREAM_INTERVAL_MS).cast("bigint"),
        }
    )
    tables = TableBuffer(spark, routes, f"{out}/buffer", started_ms=0)

    for number in range(n_polls):
        now = STREAM_PERIOD_MS * (number + 1)

        def poll(kept: DataFrame, epoch: int, now: int = now, number: int = number) -> None:
            flushed = tables.poll(kept, number, now)
            if flushed is not None:
                flushed.write.mode("overwrite").parquet(f"{out}/batches/epoch={number}")

        _arrive(spark, out, number)
        # Each start goes on from the checkpoint and takes in what has arrived.
        stream = (
            lines.writeStream.foreachBatch(poll)
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
        if not is_written(spark, f"{out}/buffer/clock/epoch={number}"):
            # Nothing arrived: the stream had no micro-batch, but the poll took place.
            poll(spark.createDataFrame([], STREAM_SCHEMA), number)
    return tables, f"{out}/batches"


@query
def stream_table_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buffer flushed: a row per batch, whatever parts it was cut into."""
    _, folder = _table_buffered(spark, sf_dir)
    parts = spark.read.schema(f"{BATCH_SCHEMA}, epoch bigint").parquet(folder)
    lines = parts.select(
        "route_id", "batch_id", "flush_at", "reason", "part",
        F.posexplode("entries").alias("at", "entry"),
    ).withColumn("line", F.col("entry.line"))
    whole = lines.repartition("route_id", "batch_id").sortWithinPartitions(
        "route_id", "batch_id", "part", "at"
    )
    columns = whole.select("route_id", "batch_id", "flush_at", "reason", "line")
    return columns.mapInArrow(_digest_lines, DIGEST_SCHEMA)


DIGEST_SCHEMA = (
    "route_id bigint, batch_id bigint, flush_at bigint, reason string, "
    "n_entries bigint, lines_md5 string"
)


def _digest_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and digest the lines of each batch as they pass, in the order they come."""
    current, n, md5 = None, 0, None

    def digested() -> pa.RecordBatch:
        names = ["route_id", "batch_id", "flush_at", "reason", "n_entries", "lines_md5"]
        values = (*current, n, md5.hexdigest() if md5 else None)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([value], kind) for value, kind in zip(values, types)], names=names
        )

    for rows in batches:
        if not rows.num_rows:
            continue
        route, batch = (rows.column(name).to_numpy() for name in ("route_id", "batch_id"))
        changes = np.flatnonzero((route[1:] != route[:-1]) | (batch[1:] != batch[:-1])) + 1
        bounds = [0, *changes.tolist(), rows.num_rows]
        for start, stop in zip(bounds, bounds[1:]):
            key = tuple(rows.column(i)[start].as_py() for i in range(4))
            if key != current:
                if current is not None:
                    yield digested()
                current, n, md5 = key, 0, None
            n += stop - start
            lines = rows.column("line").slice(start, stop - start).drop_null().to_pylist()
            if lines:
                text = "\n".join(lines)
                if md5 is None:
                    md5 = hashlib.md5(usedforsecurity=False)
                else:
                    text = "\n" + text
                md5.update(text.encode())
    if current is not None:
        yield digested()


@query
def stream_pending_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buffer of a stopped stream still holds."""
    tables, _ = _table_buffered(spark, sf_dir)
    return tables.pending_lines().drop("epoch")


@query
def stream_flush_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushes of a stopped stream by route and reason."""
    tables, _ = _table_buffered(spark, sf_dir)
    return tables.flush_log()


def _await_lines(stream, path: str, n_lines: int) -> None:
    """Return once a running stream has written all lines."""
    spark = SparkSession.active()
    while stream.isActive:
        time.sleep(0.3)
        progress = stream.lastProgress
        if progress is None or progress["batchId"] < 1:
            continue
        batches = spark.read.schema(BATCH_SCHEMA).parquet(path)
        if (batches.agg(F.sum("n_entries")).first()[0] or 0) == n_lines:
            return
    raise stream.exception() or RuntimeError("the stream was stopped from outside")
