"""Encode batches and entries for their destinations.

``entries`` is ``ARRAY<STRUCT<path, line>>``.  Send times are ``TIMESTAMP_NTZ``
columns holding UTC, so that no session zone can change an encoded byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priority of facility local0 (16) and severity info (6), the host
# name of a sender without one, and the content types of the two POST bodies.
SYSLOG_PRIORITY = 134
UNKNOWN_HOST = "unknown"
JSON_CONTENT_TYPE = "application/json"
NDJSON_CONTENT_TYPE = "application/x-ndjson"
DEFAULT_TAG = "millrace"

# Month names of a syslog time stamp.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

PAYLOAD_SCHEMA = "array<struct<path:string,line:string>>"


def now_utc() -> Column:
    """The current time as ``TIMESTAMP_NTZ`` in UTC."""
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
    )


def parsed_json(text: Column) -> Column:
    """The text as a variant, or NULL unless it is exactly one JSON value.

    The parser stops after the first value and would overlook what follows.
    Whatever follows can continue a list or an object around it, never both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = (
        listed.isNotNull()
        & keyed.isNotNull()
        & F.try_variant_get(listed, "$[0]", "variant").isNotNull()
        & F.try_variant_get(listed, "$[1]", "variant").isNull()
    )
    return F.when(alone, F.try_parse_json(text))


def http_payload(entries: Column) -> Column:
    """``[{"path":…,"line":…},…]``"""
    return F.to_json(entries)


def jsonl_record(path: Column, line: Column) -> Column:
    """``{"path":…,"line":…}``; the sink adds the line feed."""
    return F.to_json(F.struct(path.alias("path"), line.alias("line")))


def rfc3339(ts: Column) -> Column:
    """UTC time with 0, 3 or 6 fractional digits and a numeric offset."""
    text = ts.cast("string")
    fraction = F.substring(text, 21, 6)
    digits = F.when(F.length(fraction) <= 3, 3).otherwise(6)
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.when(fraction == "", F.lit("")).otherwise(
            F.concat(F.lit("."), F.rpad(fraction, digits, F.lit("0")))
        ),
        F.lit("+00:00"),
    )


def bulk_body(entries: Column, index: Column, ship_ts: Column) -> Column:
    """Action and document line per entry, each ended by a line feed."""
    action = F.to_json(F.struct(F.struct(index.alias("_index")).alias("index")))
    stamp = rfc3339(ship_ts)

    def pair(entry: Column) -> Column:
        document = F.struct(
            stamp.alias("@timestamp"), entry["path"].alias("path"), entry["line"].alias("message")
        )
        return F.concat(action, F.lit("\n"), F.to_json(document), F.lit("\n"))

    return F.array_join(F.transform(entries, pair), "")


def bulk_url(url: Column) -> Column:
    """Base address without trailing slashes, then ``/_bulk``."""
    return F.concat(F.rtrim(url, F.lit("/")), F.lit("/_bulk"))


def syslog_time(ship_ts: Column, zone: str = "UTC") -> Column:
    """``Dec 03 14:23:45`` in the sender's zone, day padded with a zero."""
    local = ship_ts if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ship_ts)
    text = local.cast("string")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(local))
    return F.concat_ws(" ", month, F.substring(text, 9, 2), F.substring(text, 12, 8))


def syslog_message(
    path: Column,
    line: Column,
    ship_ts: Column,
    host: Column | None = None,
    tag: str = DEFAULT_TAG,
    zone: str = "UTC",
) -> Column:
    """``<134>MMM dd HH:mm:ss HOST TAG: [PATH] LINE``"""
    sender = F.lit(UNKNOWN_HOST) if host is None else F.coalesce(host, F.lit(UNKNOWN_HOST))
    return F.concat(
        F.lit(f"<{SYSLOG_PRIORITY}>"),
        syslog_time(ship_ts, zone),
        F.lit(" "),
        sender,
        F.lit(f" {tag}: ["),
        path,
        F.lit("] "),
        line,
    )


def syslog_messages(entries: Column, ship_ts: Column, **options) -> Column:
    """The messages of a batch, in entry order."""
    return F.transform(
        entries, lambda e: syslog_message(e["path"], e["line"], ship_ts, **options)
    )


def tcp_frame(messages: Column) -> Column:
    """Messages of one connection, each ended by a line feed."""
    return F.concat(F.array_join(messages, "\n"), F.lit("\n"))


def authorization(api_key: Column, basic: Column) -> Column:
    """Bearer token, else basic credentials, else NULL."""
    pair = F.concat(basic["username"], F.lit(":"), basic["password"])
    # base64() breaks its output into lines of 76 characters.
    encoded = F.translate(F.base64(F.encode(pair, "UTF-8")), "\r\n", "")
    return F.when(api_key.isNotNull(), F.concat(F.lit("Bearer "), api_key)).when(
        basic.isNotNull(), F.concat(F.lit("Basic "), encoded)
    )
