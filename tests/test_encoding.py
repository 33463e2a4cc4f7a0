from __future__ import annotations

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import encoding as E
from millrace.sinks.requests import decode_payload

LINES = ['plain', 'quote " and \\ backslash', "tab\tand \x1b control", "über ☃ 😀", "", "a/b </script>"]


@pytest.fixture(scope="module")
def batch(spark):
    entries = [{"path": "/var/log/a.log", "line": line} for line in LINES]
    return spark.createDataFrame(
        [(entries, datetime(2025, 12, 3, 14, 23, 45, 120000))],
        f"entries {E.PAYLOAD_SCHEMA}, ship_ts timestamp_ntz",
    )


def test_http_payload_and_jsonl(batch):
    payload = batch.select(E.http_payload(F.col("entries"))).first()[0]
    want = [{"path": "/var/log/a.log", "line": line} for line in LINES]
    assert json.loads(payload) == want
    record = batch.select(E.jsonl_record(F.lit("/p"), F.lit("l"))).first()[0]
    assert record == '{"path":"/p","line":"l"}'


def test_single_entry_batch_is_an_array_of_one(batch):
    one = batch.select(E.http_payload(F.slice("entries", 1, 1))).first()[0]
    assert one == '[{"path":"/var/log/a.log","line":"plain"}]'


def test_bulk_body(batch):
    body = batch.select(E.bulk_body(F.col("entries"), F.lit("logs"), F.col("ship_ts"))).first()[0]
    assert body.endswith("\n")
    rows = [json.loads(x) for x in body[:-1].split("\n")]
    assert rows[0::2] == [{"index": {"_index": "logs"}}] * len(LINES)
    assert rows[1::2] == [
        {"@timestamp": "2025-12-03T14:23:45.120+00:00", "path": "/var/log/a.log", "message": line}
        for line in LINES
    ]


@pytest.mark.parametrize(
    ("micros", "text"), [(0, ""), (500000, ".500"), (1000, ".001"), (1, ".000001"), (120340, ".120340")]
)
def test_rfc3339_fraction(spark, micros, text):
    df = spark.createDataFrame([(datetime(2025, 1, 2, 3, 4, 5, micros),)], "t timestamp_ntz")
    assert df.select(E.rfc3339(F.col("t"))).first()[0] == f"2025-01-02T03:04:05{text}+00:00"


def test_syslog(spark, batch):
    first = F.element_at("entries", 1)
    message = E.syslog_message(first["path"], first["line"], F.col("ship_ts"), tag="t")
    assert batch.select(message).first()[0] == "<134>Dec 03 14:23:45 unknown t: [/var/log/a.log] plain"
    named = E.syslog_message(
        first["path"], first["line"], F.col("ship_ts"), host=F.lit("h"), tag="t", zone="Asia/Tokyo"
    )
    assert batch.select(named).first()[0].startswith("<134>Dec 03 23:23:45 h t: ")
    messages = E.syslog_messages(F.col("entries"), F.col("ship_ts"), tag="t")
    frame = batch.select(E.tcp_frame(messages)).first()[0]
    assert frame.endswith("\n") and frame.count("\n") == len(LINES)


def test_encoded_times_ignore_the_session_zone(spark, batch):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS t")
        row = gap.select(E.rfc3339(F.col("t")), E.syslog_time(F.col("t"))).first()
        assert tuple(row) == ("2024-03-10T02:30:00+00:00", "Mar 10 02:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("url", ["http://e:9200", "http://e:9200/", "http://e:9200///"])
def test_bulk_url(spark, url):
    assert spark.range(1).select(E.bulk_url(F.lit(url))).first()[0] == "http://e:9200/_bulk"


def test_authorization(spark):
    user, password = "shop", "p" * 120
    df = spark.createDataFrame(
        [(0, "k", (user, password)), (1, None, (user, password)), (2, "", (user, password)), (3, None, None)],
        "i int, api_key string, basic struct<username:string,password:string>",
    )
    rows = df.select("i", E.authorization(F.col("api_key"), F.col("basic")).alias("h")).orderBy("i")
    basic = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()
    assert [r["h"] for r in rows.collect()] == ["Bearer k", basic, "Bearer ", None]


@pytest.mark.parametrize(
    ("body", "rows"),
    [
        ('[{"path":"p","line":"l"},{"line":"m"}]', [(1, "p", "l"), (2, "unknown", "m")]),
        ('{"path":"p"}', [(1, "p", "")]),
        ("[]", []),
        ("", "Empty request body"),
        (None, "Empty request body"),
        ("nope", "Invalid JSON"),
        ('{"path":"p"}}', "Invalid JSON"),
        ('[{"path":"p"}],[1', "Invalid JSON"),
        ('{"path":"p"},{"path":"q"}', "Invalid JSON"),
    ],
)
def test_decode_payload(spark, body, rows):
    df = spark.createDataFrame([(7, body)], "id int, body string")
    got = decode_payload(df, "body", ["id"]).orderBy("i").collect()
    if isinstance(rows, str):
        assert [(r["id"], r["error"], r["line"]) for r in got] == [(7, rows, None)]
    else:
        assert [(r["i"], r["path"], r["line"]) for r in got] == rows


def test_payload_round_trip(batch):
    body = batch.select(F.lit(1).alias("id"), E.http_payload(F.col("entries")).alias("body"))
    got = decode_payload(body, "body", ["id"]).orderBy("i").collect()
    assert [r["line"] for r in got] == LINES
