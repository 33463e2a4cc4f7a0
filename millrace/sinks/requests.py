"""Turn batches into delivery requests.

A request is one row ``(request_id, route_id, batch_id, part, n_entries, type,
url, headers, payloads)``.  ``payloads`` are sent in order: the body of a POST,
the stream of one TCP connection, or the datagrams of a UDP batch.  The
destination type selects the encoder inside one projection, so the batches are
produced once whatever the mix of destinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import encoding as E
from millrace.session import join_checked


def build_requests(
    batches: DataFrame,
    routes: DataFrame,
    ship_ts: Column | None = None,
    host: str | None = None,
    tag: str = E.DEFAULT_TAG,
    zone: str = "UTC",
) -> DataFrame:
    """Encode every batch for the destination of its route.

    ``batches`` has ``route_id, batch_id, part, n_entries, entries``; ``ship_ts``
    is the send time (default: now).
    """
    ship_ts = E.now_utc() if ship_ts is None else ship_ts
    joined = join_checked(
        batches.withColumn("_ship_ts", ship_ts),
        routes.select("route_id", F.col("destination").alias("_dest")),
        ["route_id"],
        spread=["batch_id"],
    )
    dest, entries, stamp = F.col("_dest"), F.col("entries"), F.col("_ship_ts")
    kind = dest["type"]
    messages = E.syslog_messages(
        entries, stamp, host=None if host is None else F.lit(host), tag=tag, zone=zone
    )
    protocol = F.lower(dest["protocol"])
    payloads = (
        F.when(kind == "http", F.array(E.http_payload(entries)))
        .when(kind == "elasticsearch", F.array(E.bulk_body(entries, dest["index"], stamp)))
        .when((kind == "syslog") & (protocol == "tcp"), F.array(E.tcp_frame(messages)))
        .when(kind == "syslog", messages)
        .when(kind == "file", F.transform(entries, lambda e: E.jsonl_record(e["path"], e["line"])))
    )
    return joined.select(
        F.concat_ws("-", "route_id", "batch_id", "part").alias("request_id"),
        "route_id",
        "batch_id",
        "part",
        "n_entries",
        kind.alias("type"),
        request_url(dest).alias("url"),
        request_headers(dest).alias("headers"),
        payloads.alias("payloads"),
    )


def request_url(dest: Column) -> Column:
    """Where a request goes; syslog targets read ``protocol://host:port``."""
    kind = dest["type"]
    return (
        F.when(kind == "http", dest["endpoint"])
        .when(kind == "elasticsearch", E.bulk_url(dest["url"]))
        .when(
            kind == "syslog",
            F.concat(
                F.lower(dest["protocol"]),
                F.lit("://"),
                dest["host"],
                F.lit(":"),
                dest["port"].cast("string"),
            ),
        )
        .when(kind == "file", dest["path"])
    )


def request_headers(dest: Column) -> Column:
    """Content type, and for HTTP the authorization header when configured."""
    kind = dest["type"]
    auth = E.authorization(dest["api_key"], dest["basic"])
    plain = F.create_map(F.lit("Content-Type"), F.lit(E.JSON_CONTENT_TYPE))
    return (
        F.when(
            (kind == "http") & auth.isNotNull(),
            F.map_concat(plain, F.create_map(F.lit("Authorization"), auth)),
        )
        .when(kind == "http", plain)
        .when(
            kind == "elasticsearch",
            F.create_map(F.lit("Content-Type"), F.lit(E.NDJSON_CONTENT_TYPE)),
        )
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def decode_payload(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """The receiver's step: a JSON body back to ``(keys…, i, path, line, error)``.

    Accepts an array or a single object and counts from 1.  A missing ``path``
    reads ``unknown`` and a missing ``line`` is empty.  An empty or malformed
    body gives one row with an error.
    """
    text = F.col(body)
    parsed = E.parsed_json(text)
    kind = F.schema_of_variant(parsed)
    is_array = kind.startswith("ARRAY")
    is_object = kind.startswith("OBJECT")
    entries = F.when(is_array, F.from_json(text, E.PAYLOAD_SCHEMA)).when(
        is_object, F.array(F.from_json(text, "path string, line string"))
    )
    error = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "Empty request body").when(
        F.coalesce(~(is_array | is_object), F.lit(True)), "Invalid JSON"
    )
    decoded = df.select(*keys, error.alias("error"), entries.alias("_entries"))
    shown = F.when(F.col("error").isNotNull(), F.array(F.lit(None))).otherwise(F.col("_entries"))
    failed = F.col("error").isNotNull()
    return decoded.select(*keys, "error", F.posexplode(shown).alias("_pos", "_entry")).select(
        *keys,
        F.when(~failed, F.col("_pos") + 1).cast("bigint").alias("i"),
        F.when(~failed, F.coalesce(F.col("_entry.path"), F.lit("unknown"))).alias("path"),
        F.when(~failed, F.coalesce(F.col("_entry.line"), F.lit(""))).alias("line"),
        "error",
    )
