"""The routes table: schema, loading, defaults and validation.

A route says which path to read, how often to poll it, when to flush its
buffer, which lines to keep and where to deliver them.  The same path may
appear in several routes, so ``route_id`` (the position in the list) is the key.
"""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.predicates import first_bad_pattern
from millrace.session import is_small

# Defaults of a route.
DEFAULT_BUFFER_SIZE = 100
DEFAULT_FLUSH_INTERVAL_MS = 30_000
DEFAULT_SYSLOG_PORT = 514
DEFAULT_SYSLOG_PROTOCOL = "udp"

# Destination types and syslog protocols.
DESTINATION_TYPES = ("http", "syslog", "elasticsearch", "file")
SYSLOG_PROTOCOLS = ("udp", "tcp")

# Messages of a rejected route.
NO_ENDPOINT = "HTTP destination requires an endpoint"
NO_CREDENTIALS = "HTTP destination requires auth, but no API key or basic auth was provided"
NO_HOST = "Syslog destination requires 'host' field"
NO_URL = "Elasticsearch destination requires 'url' field"
NO_INDEX = "Elasticsearch destination requires 'index' field"
NO_FILE_PATH = "File destination requires 'path' field"

BASIC_SCHEMA = T.StructType(
    [
        T.StructField("username", T.StringType(), False),
        T.StructField("password", T.StringType(), False),
    ]
)

DESTINATION_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType(), False),
        T.StructField("endpoint", T.StringType()),
        T.StructField("require_auth", T.BooleanType()),
        T.StructField("api_key", T.StringType()),
        T.StructField("basic", BASIC_SCHEMA),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("index", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)

ROUTE_SCHEMA = T.StructType(
    [
        T.StructField("route_id", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("polling_frequency_ms", T.LongType(), False),
        T.StructField("buffer_size", T.LongType()),
        T.StructField("flush_interval_ms", T.LongType()),
        T.StructField("match_on", T.ArrayType(T.StringType(), False)),
        T.StructField("exclude_on", T.ArrayType(T.StringType(), False)),
        T.StructField("destination", DESTINATION_SCHEMA, False),
    ]
)


class ConfigError(ValueError):
    """The configuration as a whole cannot be used."""


class _ConfigLoader(yaml.SafeLoader):
    """YAML with the core-schema scalars only: null, bool, int and float."""

    yaml_implicit_resolvers: dict[str, list] = {}

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for key in keys:
            if keys.count(key) > 1:
                raise ConfigError(f"duplicate field '{key}'")
        return super().construct_mapping(node, deep)


# Scalar spellings of the YAML core schema.
_ConfigLoader.add_implicit_resolver(
    "tag:yaml.org,2002:null", re.compile(r"(?:~|null|Null|NULL|)\Z"), ["~", "n", "N", ""]
)
_ConfigLoader.add_implicit_resolver(
    "tag:yaml.org,2002:bool", re.compile(r"(?:true|True|TRUE|false|False|FALSE)\Z"), list("tTfF")
)
_ConfigLoader.add_implicit_resolver(
    "tag:yaml.org,2002:int", re.compile(r"[-+]?(?:0|[1-9][0-9]*)\Z"), list("-+0123456789")
)
_ConfigLoader.add_implicit_resolver(
    "tag:yaml.org,2002:float",
    re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?\Z"),
    list("-+.0123456789"),
)


def load_routes(spark: SparkSession, path: str) -> DataFrame:
    """Read a YAML configuration file into a routes table.

    Any malformed or incomplete configuration fails as a whole; an empty list
    of routes is legal.
    """
    try:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    except (OSError, UnicodeDecodeError) as problem:
        raise ConfigError(f"cannot read {path}: {problem}") from problem
    return parse_routes(spark, text)


def parse_routes(spark: SparkSession, text: str) -> DataFrame:
    """Turn YAML text into a routes table with defaults filled in."""
    try:
        document = yaml.load(text, Loader=_ConfigLoader)
    except yaml.YAMLError as problem:
        raise ConfigError(f"malformed YAML: {problem}") from problem
    if not isinstance(document, dict) or not isinstance(document.get("log_files"), list):
        raise ConfigError("'log_files' must be a list")
    rows = [
        {"route_id": i, **_typed(entry, ROUTE_SCHEMA, f"log_files[{i}]", skip=("route_id",))}
        for i, entry in enumerate(document["log_files"])
    ]
    return normalize_routes(routes_table(spark, rows))


def routes_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A routes table from dictionaries, held as a local relation."""
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(ROUTE_SCHEMA))
    return spark.createDataFrame(table, ROUTE_SCHEMA)


def _typed(entry: Any, schema: T.StructType, where: str, skip: tuple = ()) -> dict:
    if not isinstance(entry, dict):
        raise ConfigError(f"{where}: expected a mapping")
    out = {}
    for field in schema.fields:
        if field.name in skip:
            continue
        present = field.name in entry
        if not present and not field.nullable:
            raise ConfigError(f"{where}: missing field '{field.name}'")
        # Only the settings of a destination may be spelled out as null.
        may_be_null = field.nullable and schema is DESTINATION_SCHEMA
        if not present or (entry[field.name] is None and may_be_null):
            out[field.name] = None
            continue
        out[field.name] = _typed_value(entry[field.name], field.dataType, f"{where}.{field.name}")
    return out


def _typed_value(value: Any, kind: T.DataType, where: str) -> Any:
    if isinstance(kind, T.StructType):
        return _typed(value, kind, where)
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ConfigError(f"{where}: expected a list")
        return [_typed_value(v, kind.elementType, f"{where}[]") for v in value]
    expected, limit = {
        T.StringType: (str, None),
        T.BooleanType: (bool, None),
        T.LongType: (int, 2**63 - 1),
        T.IntegerType: (int, 65_535),
    }[type(kind)]
    if type(value) is not expected or (limit is not None and not 0 <= value <= limit):
        raise ConfigError(f"{where}: invalid value {value!r}")
    return value


def normalize_routes(routes: DataFrame) -> DataFrame:
    """Fill in the defaults of unset route fields."""
    empty = F.array().cast("array<string>")
    return routes.select(
        "route_id",
        "path",
        "polling_frequency_ms",
        F.coalesce("buffer_size", F.lit(DEFAULT_BUFFER_SIZE).cast("bigint")).alias("buffer_size"),
        F.coalesce("flush_interval_ms", F.lit(DEFAULT_FLUSH_INTERVAL_MS).cast("bigint")).alias(
            "flush_interval_ms"
        ),
        F.coalesce("match_on", empty).alias("match_on"),
        F.coalesce("exclude_on", empty).alias("exclude_on"),
        _normalize_destination(F.col("destination")).alias("destination"),
    )


def _normalize_destination(dest: Column) -> Column:
    is_syslog = dest["type"] == "syslog"
    return (
        dest.withField("require_auth", F.coalesce(dest["require_auth"], F.lit(False)))
        .withField(
            "port",
            F.when(is_syslog, F.coalesce(dest["port"], F.lit(DEFAULT_SYSLOG_PORT))).otherwise(
                dest["port"]
            ),
        )
        .withField(
            "protocol",
            F.when(
                is_syslog, F.coalesce(dest["protocol"], F.lit(DEFAULT_SYSLOG_PROTOCOL))
            ).otherwise(dest["protocol"]),
        )
    )


def has_auth(dest: Column) -> Column:
    """A non-empty API key or a basic pair is configured."""
    api_key = dest["api_key"]
    return (api_key.isNotNull() & (api_key != "")) | dest["basic"].isNotNull()


def destination_problem(dest: Column) -> Column:
    """First reason why a destination cannot be built, else NULL."""
    kind = dest["type"]
    protocol = F.coalesce(dest["protocol"], F.lit(DEFAULT_SYSLOG_PROTOCOL))
    # A header value may hold tabs and visible ASCII only.
    bad_key = dest["api_key"].isNotNull() & ~dest["api_key"].rlike(r"\A[\t\x20-\x7E]*\z")

    def first_of(*cases: tuple[Column, Column]) -> Column:
        return F.coalesce(*[F.when(test, message) for test, message in cases])

    http = first_of(
        (dest["endpoint"].isNull(), F.lit(NO_ENDPOINT)),
        (F.coalesce(dest["require_auth"], F.lit(False)) & ~has_auth(dest), F.lit(NO_CREDENTIALS)),
        (bad_key, F.lit("failed to parse header value")),
    )
    syslog = first_of(
        (dest["host"].isNull(), F.lit(NO_HOST)),
        (
            ~F.lower(protocol).isin(*SYSLOG_PROTOCOLS),
            F.concat(F.lit("Invalid syslog protocol: "), protocol, F.lit(" (use 'udp' or 'tcp')")),
        ),
        (
            ~F.coalesce(dest["port"], F.lit(0)).between(0, 65535),
            F.lit("Invalid syslog port (use 0 to 65535)"),
        ),
    )
    elasticsearch = first_of(
        (dest["url"].isNull(), F.lit(NO_URL)),
        (dest["index"].isNull(), F.lit(NO_INDEX)),
    )
    file = F.when(dest["path"].isNull(), F.lit(NO_FILE_PATH))
    return (
        F.when(kind == "http", http)
        .when(kind == "syslog", syslog)
        .when(kind == "elasticsearch", elasticsearch)
        .when(kind == "file", file)
        .otherwise(F.concat(F.lit("Unknown destination type: "), F.coalesce(kind, F.lit("<none>"))))
    )


def validate_routes(routes: DataFrame) -> DataFrame:
    """Add ``valid``, ``error`` and ``warning`` to a normalized routes table.

    The destination is checked first, then the allow-list, the deny-list and
    the poll period.  A bad route never stops the others.
    """
    dest = F.col("destination")
    error = F.coalesce(
        destination_problem(dest),
        F.concat(F.lit("Invalid match_on regex "), F.col("_bad_match")),
        F.concat(F.lit("Invalid exclude_on regex "), F.col("_bad_exclude")),
        F.when(
            F.coalesce("polling_frequency_ms", F.lit(0)) < 1,
            F.lit("polling_frequency_ms must be at least 1"),
        ),
        F.when(F.col("buffer_size") < 0, F.lit("buffer_size must not be negative")),
        F.when(F.col("flush_interval_ms") < 0, F.lit("flush_interval_ms must not be negative")),
    )
    # An empty key still wins over a basic pair when the header is built.
    empty_key = (dest["type"] == "http") & (dest["api_key"] == "") & dest["basic"].isNotNull()
    return (
        routes.withColumn("_bad_match", first_bad_pattern("match_on"))
        .withColumn("_bad_exclude", first_bad_pattern("exclude_on"))
        .withColumn("error", error)
        .withColumn("valid", F.col("error").isNull())
        .withColumn(
            "warning", F.when(empty_key, F.lit("empty api_key hides the basic credentials"))
        )
        .drop("_bad_match", "_bad_exclude")
    )


def active_routes(routes: DataFrame) -> DataFrame:
    """The routes that pass validation."""
    return (
        validate_routes(routes).filter("valid").select(*[f.name for f in ROUTE_SCHEMA.fields])
    )


def ready_routes(spark: SparkSession, routes: DataFrame) -> DataFrame:
    """Normalized valid routes, with the validation done once.

    A table of checked size becomes a local relation; a larger one stays a plan.
    """
    ready = active_routes(normalize_routes(routes))
    if not is_small(ready):
        return ready
    return routes_table(spark, [row.asDict(recursive=True) for row in ready.collect()])
