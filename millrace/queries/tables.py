"""Line, route and scan tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.routes import ROUTE_SCHEMA, normalize_routes, routes_table
from millrace.sources.text import frame_lines

# Event times count from here.
ORIGIN = "2024-01-01 00:00:00"

# The routes stop after the 30 days the events cover.
HORIZON_MS = 30 * 24 * 3600 * 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event: ``(path, offset, arrival_us, ts, line)``.

    Event ids grow with time, so they serve as the order key within a path.
    """
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("/var/log/app/"), "event_type", F.lit(".log")).alias("path"),
        F.col("event_id").alias("offset"),
        F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', ts)").alias("arrival_us"),
        "ts",
        F.expr(
            """concat('[', substring(CAST(ts AS STRING), 1, 19), '] ',
            CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                            WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END,
            ' - user_', CAST(user_id AS STRING), ' ', event_type,
            ' took ', CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), 'ms EVT-',
            lpad(CAST(event_id % 10000 AS STRING), 4, '0'),
            CASE user_id % 10 WHEN 0 THEN ' [test]' WHEN 1 THEN ' [dev]' ELSE '' END)"""
        ).alias("line"),
    )


# Seven routes over the event paths: error.log twice with different rules, one
# route whose path has no lines, and signup.log without any route.
_ROUTES = [
    ("/var/log/app/error.log", 600_000, 7, 21_600_000, ["ERROR"], [],
     {"type": "http", "endpoint": "http://collector:8000/ingest", "api_key": "k-123"}),
    ("/var/log/app/error.log", 300_000, 20, 3_600_000, [r"EVT-[0-9]{4}"], [r"\[test\]", "error.*dev"],
     {"type": "elasticsearch", "url": "http://search:9200//", "index": "logs-errors"}),
    ("/var/log/app/click.log", 600_000, 50, 7_200_000, [], [],
     {"type": "syslog", "host": "audit.local", "protocol": "TCP"}),
    ("/var/log/app/view.log", 900_000, 12, 43_200_000, [], [r"EVT-1\d{3}"],
     {"type": "syslog", "host": "audit.local"}),
    ("/var/log/app/purchase.log", 60_000, 5, 1_800_000, [r"took [1-9]\d{3,}ms", "WARN"], ["DEBUG"],
     {"type": "file", "path": "/backup/purchase.jsonl"}),
    ("/var/log/app/idle.log", 1_000, None, None, None, None,
     {"type": "http", "endpoint": "http://collector:8000/idle"}),
    ("/var/log/app/purchase.log", 3_600_000, 100, 86_400_000, ["WARN"], [r"\[dev\]"],
     {"type": "http", "endpoint": "http://collector:8000/orders",
      "basic": {"username": "shop", "password": "a rather long password, long enough to be wrapped by base64"}}),
]


def event_routes(spark: SparkSession) -> DataFrame:
    names = [f.name for f in ROUTE_SCHEMA.fields]
    rows = [dict(zip(names, (i, *route))) for i, route in enumerate(_ROUTES)]
    return normalize_routes(routes_table(spark, rows))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_lines(read(spark, sf_dir, "documents"), "text", ["doc_id"])


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as files: ``(path, inode, size, head, state, text)``.

    ``state`` deals out the six situations a scan can meet, so that every
    document takes part; ``head`` is the size of the first line.
    """
    size = F.octet_length("text")
    return read(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "doc_id").alias("path"),
        (F.col("doc_id") + 1000).alias("inode"),
        size.cast("bigint").alias("size"),
        F.least(F.octet_length(F.substring_index("text", "\n", 1)) + 1, size)
        .cast("bigint")
        .alias("head"),
        (F.col("doc_id") % 6).alias("state"),
        "text",
    )


def listing_and_cursor(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is there now and what has been read.

    State 0 has no cursor yet, 1 has grown, 2 is unchanged, 3 was truncated,
    4 was rotated and 5 has gone missing.
    """
    state = F.col("state")
    listing = files.filter(state != 5).select("path", "inode", "size")
    cursor = files.filter(state != 0).select(
        "path",
        F.when(state == 4, F.col("inode") + 1).otherwise(F.col("inode")).alias("inode"),
        F.when(state == 1, F.col("head"))
        .when(state == 3, F.col("size") + 10)
        .otherwise(F.col("size"))
        .alias("position"),
    )
    return listing, cursor


def supplier_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw route per supplier, dealt over 16 kinds of right and wrong settings."""
    kind = F.col("s_suppkey") % 16

    def pick(values: dict[int, object], default=None, cast: str = "string"):
        out = F.lit(default).cast(cast)
        for k, v in values.items():
            value = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
            out = F.when(kind == k, value.cast(cast)).otherwise(out)
        return out

    types = {
        **dict.fromkeys((0, 1, 2, 3, 11, 12, 13), "http"),
        **dict.fromkeys((4, 5, 6), "syslog"),
        **dict.fromkeys((7, 8), "elasticsearch"),
        **dict.fromkeys((9, 10), "file"),
        14: "unknown",
        15: "http",
    }
    endpoint = F.when(
        kind.isin(0, 2, 3, 11, 12, 13, 15), F.concat(F.lit("http://"), "s_name", F.lit("/in"))
    )
    basic = F.when(
        kind == 3, F.struct(F.col("s_name").alias("username"), F.lit("pw").alias("password"))
    )
    destination = F.struct(
        pick(types).alias("type"),
        endpoint.alias("endpoint"),
        pick({2: True, 3: True}, cast="boolean").alias("require_auth"),
        pick({0: "key", 2: "", 3: ""}).alias("api_key"),
        basic.alias("basic"),
        pick({4: "h1", 6: "h2"}).alias("host"),
        pick({6: 1514}, cast="int").alias("port"),
        pick({4: "icmp", 6: "TCP"}).alias("protocol"),
        pick({7: "http://search:9200", 8: "http://search:9200"}).alias("url"),
        pick({8: "logs"}).alias("index"),
        pick({9: "/backup/out.jsonl"}).alias("path"),
    )
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("route_id"),
        F.concat(F.lit("/var/log/"), "s_name", F.lit(".log")).alias("path"),
        F.when(kind == 13, 0).otherwise(500).cast("bigint").alias("polling_frequency_ms"),
        F.when(kind % 2 == 0, F.col("s_nationkey") + 1).cast("bigint").alias("buffer_size"),
        F.when(kind % 3 == 0, F.lit(15000)).cast("bigint").alias("flush_interval_ms"),
        pick({8: ["ERROR", "WARN"], 11: ["ERROR", "[invalid"]}, cast="array<string>").alias("match_on"),
        pick({8: ["DEBUG"], 12: ["(?=x)"]}, cast="array<string>").alias("exclude_on"),
        destination.alias("destination"),
    )
