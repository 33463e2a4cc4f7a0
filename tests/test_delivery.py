from __future__ import annotations

import http.client
import io
import json
import os
import pickle
import socket
import urllib.error

import pytest
from pyspark.sql import functions as F

from millrace.plans.routes import normalize_routes, routes_table
from millrace.plans.shipping import ship_table
from millrace.sinks import transports
from millrace.session import is_marked, move_files
from millrace.sinks import files
from millrace.sinks.delivery import check_bulk_response, deliver, journal_path, send, settle
from millrace.sinks.files import prepare_file_routes, write_file_routes
from millrace.sinks.journal import Journal, TaskJournal
from millrace.sinks.requests import build_requests

BATCHES = (
    "route_id long, batch_id long, part long, n_entries long, "
    "entries array<struct<path:string,line:string>>"
)


def routes_of(spark, *destinations, **settings):
    rows = [
        {"route_id": i, "path": f"/log/{i}", "polling_frequency_ms": 100, "destination": d, **settings}
        for i, d in enumerate(destinations)
    ]
    return normalize_routes(routes_table(spark, rows))


def requests_for(spark, *destinations, lines=("a", "b")):
    entries = [{"path": "/p", "line": line} for line in lines]
    rows = [(i, 1, 0, len(lines), entries) for i in range(len(destinations))]
    stamp = F.lit("2025-12-03 14:23:45").cast("timestamp_ntz")
    return build_requests(
        spark.createDataFrame(rows, BATCHES), routes_of(spark, *destinations), stamp, host="h", tag="t"
    )


def test_requests_by_destination(spark):
    rows = requests_for(
        spark,
        {"type": "http", "endpoint": "http://e/in", "api_key": "k"},
        {"type": "elasticsearch", "url": "http://s//", "index": "i"},
        {"type": "syslog", "host": "x", "protocol": "TCP"},
        {"type": "syslog", "host": "x", "port": 1514},
        {"type": "file", "path": "/out"},
    ).orderBy("route_id").collect()
    http, bulk, tcp, udp, file = rows
    assert http["url"] == "http://e/in"
    assert http["headers"] == {"Content-Type": "application/json", "Authorization": "Bearer k"}
    assert json.loads(http["payloads"][0]) == [{"path": "/p", "line": "a"}, {"path": "/p", "line": "b"}]
    assert (bulk["url"], bulk["headers"]) == ("http://s/_bulk", {"Content-Type": "application/x-ndjson"})
    assert len(bulk["payloads"]) == 1 and bulk["payloads"][0].count("\n") == 4
    assert tcp["url"] == "tcp://x:514"
    assert tcp["payloads"] == ["".join(f"<134>Dec 03 14:23:45 h t: [/p] {x}\n" for x in "ab")]
    assert udp["url"] == "udp://x:1514"
    assert udp["payloads"] == [f"<134>Dec 03 14:23:45 h t: [/p] {x}" for x in "ab"]
    assert file["payloads"] == ['{"path":"/p","line":"a"}', '{"path":"/p","line":"b"}']
    assert [r["request_id"] for r in rows] == [f"{i}-1-0" for i in range(5)]


def answer(status, body=""):
    return lambda request, payload: (status, body)


def outcome(spark, destination, transport):
    return settle(send(requests_for(spark, destination), transport)).first()


HTTP = {"type": "http", "endpoint": "http://e/in"}
BULK = {"type": "elasticsearch", "url": "http://s", "index": "i"}


@pytest.mark.parametrize(
    ("destination", "status", "body", "error"),
    [
        (HTTP, 200, "", None),
        (HTTP, 299, "", None),
        (HTTP, 302, "moved", "HTTP 302 from http://e/in: moved"),
        (HTTP, 500, "down", "HTTP 500 from http://e/in: down"),
        (BULK, 200, '{"errors":false}', None),
        (BULK, 200, "{}", None),
        (BULK, 200, "[]", None),
        (BULK, 200, '{"errors":"true"}', None),
        (BULK, 200, '{"errors":1}', None),
        (BULK, 200, '{"errors": true}', "Elasticsearch bulk request contained errors"),
        (BULK, 200, "nope", "Elasticsearch response is not valid JSON"),
        (BULK, 200, "", "Elasticsearch response is not valid JSON"),
        (BULK, 429, "busy", "Elasticsearch HTTP 429: busy"),
    ],
)
def test_outcomes(spark, destination, status, body, error):
    row = outcome(spark, destination, answer(status, body))
    assert (row["ok"], row["status"], row["error"]) == (error is None, status, error)
    if destination is BULK:
        responses = spark.createDataFrame([(status, body)], "status int, body string")
        checked = check_bulk_response(responses).first()
        assert (checked["ok"], checked["error"]) == (error is None, error)


def test_an_io_error_abandons_the_rest_of_the_batch(spark, tmp_path):
    log = str(tmp_path / "sent")

    def flaky(request, payload):
        with open(log, "a") as handle:
            handle.write(payload[-1])
        if payload.endswith("b"):
            raise ConnectionRefusedError("refused")
        return 200, ""

    requests = requests_for(spark, {"type": "syslog", "host": "x"}, lines=("a", "b", "c"))
    row = settle(send(requests, flaky)).first()
    assert (row["ok"], row["error"]) == (False, "ConnectionRefusedError: refused")
    assert open(log).read() == "ab"


def test_failures_may_fail_the_job(spark):
    failing = settle(send(requests_for(spark, HTTP), answer(500, "down")), on_failure="fail")
    with pytest.raises(Exception, match="HTTP 500"):
        failing.collect()


def test_a_repeated_delivery_sends_nothing_twice(spark, tmp_path):
    log = str(tmp_path / "sent")

    def counting(request, payload):
        with open(log, "a") as handle:
            handle.write("x")
        return 200, ""

    requests = requests_for(spark, HTTP, HTTP)
    out = str(tmp_path / "outcomes")
    for _ in range(2):
        assert deliver(spark, requests, counting, out).filter("ok").count() == 2
    assert open(log).read() == "xx"


def test_shipping_a_table(spark, tmp_path):
    out = str(tmp_path / "out.jsonl")
    routes = routes_of(
        spark, HTTP, {"type": "file", "path": out}, {"type": "unknown"}, buffer_size=2, exclude_on=["drop"]
    )
    lines = spark.createDataFrame(
        [(f"/log/{r}", n, 1000 * (n + 1), text) for r in range(3) for n, text in enumerate(["a", "drop me", "b"])],
        "path string, offset long, arrival_us long, line string",
    )
    for _ in range(2):  # the second run finds everything done
        outcomes = ship_table(spark, lines, routes, answer(204), str(tmp_path / "work")).collect()
        assert [(r["route_id"], r["n_entries"], r["ok"]) for r in outcomes] == [(0, 2, True)]
    written = spark.read.schema("path string, line string").json(out)
    assert sorted(tuple(r) for r in written.collect()) == [("/log/1", "a"), ("/log/1", "b")]


def test_file_routes_exist_before_anything_ships(spark, tmp_path):
    target = tmp_path / "deep" / "dir" / "out.jsonl"
    prepare_file_routes(spark, routes_of(spark, {"type": "file", "path": str(target)}))
    assert target.is_dir()
    assert spark.read.schema("path string, line string").json(str(target)).isEmpty()


class FakeConnection:
    """Answers by path; ``log`` holds every request with the number of its connection."""

    log: list = []
    opened = 0

    def __init__(self, host, port=None, timeout=None):
        FakeConnection.opened += 1
        self.number, self.host, self.port, self.sock = FakeConnection.opened, host, port, None

    def request(self, method, target, body=None, headers=None):
        if self.sock is None:
            self.sock, self.far = socket.socketpair()
        self.log.append((self.number, method, self.host, target, body, headers))
        self.target = target

    def getresponse(self):
        if self.target == "/cut":
            raise http.client.RemoteDisconnected("gone")
        status, body, location = {
            "/in?x=1": (201, "done", None),
            "/bad": (503, "later", None),
            "/moved": (307, "", "http://other:81/in?x=1"),
            "/see": (303, "", "/in?x=1"),
            "/round": (308, "", "/round"),
        }.get(self.target, (200, "", None))
        answer = io.BytesIO(body.encode())
        answer.status, answer.will_close = status, self.target == "/last"
        answer.getheader = lambda name: location
        return answer

    def close(self):
        if self.sock is not None:
            self.sock.close()
            self.far.close()


@pytest.fixture
def http_log(monkeypatch):
    monkeypatch.setattr(transports.http.client, "HTTPConnection", FakeConnection)
    monkeypatch.setattr(transports.urllib.request, "getproxies", dict)
    FakeConnection.log, FakeConnection.opened = [], 0
    return FakeConnection.log


def http_request(path: str) -> dict:
    headers = {"Authorization": "Bearer k", "Content-Type": "application/json"}
    return {"type": "http", "url": f"http://e{path}", "headers": headers}


def test_http_transport(http_log):
    ship = transports.DefaultTransport()
    assert ship(http_request("/in?x=1"), "[é]") == (201, "done")
    assert ship(http_request("/bad"), "[]") == (503, "later")
    number, method, host, target, body, headers = http_log[0]
    assert (method, host, target, body) == ("POST", "e", "/in?x=1", "[é]".encode())
    assert headers["Authorization"] == "Bearer k"
    ship.close()


def test_http_connections_are_kept_and_replaced(http_log):
    ship = transports.HttpTransport()
    for path in ("/a", "/b", "/last", "/c"):
        ship(http_request(path), "[]")
    assert [entry[0] for entry in http_log] == [1, 1, 1, 2]  # "/last" was the last of its connection
    with pytest.raises(http.client.RemoteDisconnected):
        ship(http_request("/cut"), "[]")
    ship(http_request("/d"), "[]")
    # A failed request is not made again; the next one has a new connection.
    assert [(entry[0], entry[3]) for entry in http_log[4:]] == [(2, "/cut"), (3, "/d")]
    (kept,) = ship._kept.values()
    kept.far.close()  # the other end closes an idle connection
    ship(http_request("/e"), "[]")
    assert http_log[-1][0] == 4
    assert pickle.loads(pickle.dumps(ship))._kept == {}
    ship.close()
    assert not ship._kept


def test_http_redirects(http_log):
    ship = transports.HttpTransport()
    assert ship(http_request("/moved"), "[1]") == (201, "done")
    assert http_log[-1][1:5] == ("POST", "other", "/in?x=1", b"[1]")
    assert "Authorization" not in http_log[-1][5]
    assert ship(http_request("/see"), "[1]") == (201, "done")
    assert http_log[-1][1:5] == ("GET", "e", "/in?x=1", None)
    with pytest.raises(OSError):
        ship(http_request("/round"), "[1]")
    ship.close()


def test_http_through_a_proxy(http_log, monkeypatch):
    class Response(io.BytesIO):
        status = 200

    def urlopen(post):
        if post.full_url.endswith("bad"):
            raise urllib.error.HTTPError(post.full_url, 503, "busy", {}, io.BytesIO(b"later"))
        return Response(b"proxied")

    monkeypatch.setattr(transports.urllib.request, "getproxies", lambda: {"http": "http://p"})
    monkeypatch.setattr(transports.urllib.request, "proxy_bypass", lambda host: False)
    monkeypatch.setattr(transports.urllib.request, "urlopen", urlopen)
    ship = transports.HttpTransport()
    assert ship(http_request("/in"), "[]") == (200, "proxied")
    assert ship(http_request("/bad"), "[]") == (503, "later")
    assert http_log == []


def test_syslog_transport(monkeypatch):
    sent = []

    class Socket:
        def __init__(self, *args):
            pass

        def __enter__(self):
            return self

        def __exit__(self, *exc):
            return False

        def sendall(self, data):
            sent.append(("tcp", data))

        def sendto(self, data, address):
            sent.append(("udp", data, address))

    monkeypatch.setattr(transports.socket, "create_connection", lambda address: Socket())
    monkeypatch.setattr(transports.socket, "socket", Socket)
    monkeypatch.setattr(
        transports.socket, "getaddrinfo", lambda h, p, type: [(0, 0, 0, "", (h, p))]
    )
    ship = transports.DefaultTransport()
    assert ship({"type": "syslog", "url": "tcp://x:514"}, "m\n") == (200, "")
    assert ship({"type": "syslog", "url": "udp://x:1514"}, "m") == (200, "")
    assert sent == [("tcp", b"m\n"), ("udp", b"m", ("x", 1514))]


def test_a_job_that_fails_has_stored_every_outcome_and_repeats_only_failures(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def transport(down):
        def post(request, payload):
            with open(f"{sent}/{request['request_id']}", "a") as handle:
                handle.write("x")
            return (500, "down") if down and request["batch_id"] == 3 else (200, "{}")

        return post

    one = requests_for(spark, HTTP)
    many = one.limit(1).drop("batch_id", "request_id").crossJoin(
        spark.range(1, 9).selectExpr("id as batch_id", "concat('r-', id) as request_id")
    ).select(one.columns)
    path = str(tmp_path / "outcomes")
    with pytest.raises(RuntimeError, match="r-3: HTTP 500"):
        deliver(spark, many, transport(True), path, on_failure="fail", groups=3)
    assert spark.read.parquet(path).count() == 8
    outcomes = deliver(spark, many, transport(False), path, on_failure="fail", ordered=True)
    assert outcomes.filter("ok").count() == outcomes.count() == 8
    assert {f.name: len(f.read_text()) for f in sent.iterdir()} == {
        f"r-{i}": 2 if i == 3 else 1 for i in range(1, 9)
    }


def numbered_requests(spark, n):
    one = requests_for(spark, HTTP)
    return (
        one.limit(1)
        .drop("batch_id", "request_id")
        .crossJoin(spark.range(1, n + 1).selectExpr("id as batch_id", "concat('r-', id) as request_id"))
        .select(one.columns)
    )


@pytest.mark.parametrize("ordered", [False, True])
def test_a_killed_job_repeats_only_what_was_under_way(spark, tmp_path, ordered):
    sent = tmp_path / "sent"
    sent.mkdir()

    def dying(request, payload):
        with open(f"{sent}/{request['request_id']}", "a") as handle:
            handle.write("x")
        if request["batch_id"] == 7 and not os.path.exists(f"{tmp_path}/died"):
            open(f"{tmp_path}/died", "w").close()
            os._exit(1)  # the worker is gone, as when an executor is lost
        return (500, "no") if request["batch_id"] == 4 else (200, "{}")

    requests = numbered_requests(spark, 12).coalesce(1).sortWithinPartitions("batch_id")
    out = str(tmp_path / "outcomes")
    with pytest.raises(Exception):  # noqa: B017 - a lost worker shows in many ways
        deliver(spark, requests, dying, out, ordered=ordered)
    before = {f.name for f in sent.iterdir()}
    assert "r-7" in before and len(before) < 12
    outcomes = deliver(spark, requests, dying, out, ordered=ordered)
    assert {r["request_id"]: r["ok"] for r in outcomes.collect()} == {f"r-{i}": i != 4 for i in range(1, 13)}
    assert outcomes.count() == 12
    times = {f.name: len(f.read_text()) for f in sent.iterdir()}
    assert times == {f"r-{i}": 2 if i == 7 else 1 for i in range(1, 13)}
    assert not os.path.exists(journal_path(out))


def test_a_repeated_task_goes_on_behind_its_journal(spark, tmp_path):
    journal = Journal.at(spark, str(tmp_path / "notes"))
    row = dict(zip(["request_id", "route_id", "batch_id", "part", "n_entries", "type", "url"],
                   ["a", 1, 2, 0, 3, "http", "http://e"]))
    first = TaskJournal(journal, 5, 0)
    first.add(row, 200, "ok", None)
    first.add({**row, "request_id": "b"}, None, None, "TimeoutError: late")
    # Not closed, and the last line cut short.
    (name,) = (tmp_path / "notes").iterdir()
    with open(name, "a") as handle:
        handle.write('{"request_id": "c", "sta')
    again = TaskJournal(journal, 5, 1)
    assert set(again.known) == {"a", "b"} and again.known["b"]["io_error"] == "TimeoutError: late"
    assert TaskJournal(journal, 6, 0).known == {}
    assert TaskJournal(Journal(journal.uri), 5, 0).known == {}  # another run


def test_stores_without_a_known_client_have_no_journal(spark, tmp_path):
    assert Journal.at(spark, "viewfs:///nowhere") is None
    requests = numbered_requests(spark, 3)
    outcomes = deliver(spark, requests, answer(200), str(tmp_path / "plain"), journal=False)
    assert outcomes.count() == 3


def file_batches(spark, tmp_path, n_routes=6):
    entries = [{"path": f"/p{i}", "line": f"{i}"} for i in range(3)]
    rows = [(r, b, 0, 3, [{**e, "line": f"{r}-{b}-{e['line']}"} for e in entries]) for r in range(n_routes) for b in (2, 1)]
    table = str(tmp_path / "batches")
    spark.createDataFrame(rows, BATCHES).repartition(3).write.partitionBy("route_id").parquet(table)
    targets = [{"type": "file", "path": str(tmp_path / "out" / str(r // 2))} for r in range(n_routes)]
    return spark.read.schema(BATCHES).parquet(table), routes_of(spark, *targets)


def lines_of(spark, tmp_path, target):
    got = spark.read.schema("path string, line string").json(str(tmp_path / "out" / str(target)))
    return sorted(r["line"] for r in got.collect())


def expected_lines(target, times=1):
    return sorted(f"{r}-{b}-{i}" for r in (2 * target, 2 * target + 1) for b in (1, 2) for i in range(3)) * times


def test_all_file_routes_are_one_job_and_a_replay_appends_nothing(spark, tmp_path):
    batches, routes = file_batches(spark, tmp_path)
    prepare_file_routes(spark, routes)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("append", "append")
    write_file_routes(batches, routes, str(tmp_path / "log" / "epoch=0"))
    jobs = tracker.getJobIdsForGroup("append")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 2  # the routes, and the entries
    for _ in range(2):
        write_file_routes(batches, routes, str(tmp_path / "log" / "epoch=0"))
        for target in range(3):
            assert lines_of(spark, tmp_path, target) == expected_lines(target)
    write_file_routes(batches, routes, str(tmp_path / "log" / "epoch=1"))
    assert lines_of(spark, tmp_path, 0) == sorted(expected_lines(0, 2))
    assert not [d for d in (tmp_path / "out").rglob("_staged*")]
    # Lines of a batch follow each other, and batches their numbers.
    for file in (tmp_path / "out" / "0").glob("*.json"):
        found = [json.loads(x)["line"] for x in file.read_text().splitlines()]
        assert found == sorted(found)


@pytest.mark.parametrize("moves", [0, 1, 4, 10**6])
def test_an_append_interrupted_anywhere_is_finished_by_the_next(spark, tmp_path, monkeypatch, moves):
    batches, routes = file_batches(spark, tmp_path)
    prepare_file_routes(spark, routes)
    log, done = str(tmp_path / "log" / "epoch=0"), []

    def interrupted(*arguments):
        if len(done) >= moves:
            raise KeyboardInterrupt
        done.append(move_files(*arguments))

    with monkeypatch.context() as patch:
        patch.setattr(files, "move_files", interrupted)
        if moves == 10**6:  # everything is moved, but the log entry is missing
            patch.setattr(files, "mark", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            write_file_routes(batches, routes, log)
    if moves == 0:  # readers see nothing of what is staged
        assert lines_of(spark, tmp_path, 0) == []
    write_file_routes(batches, routes, log)
    assert is_marked(spark, f"{log}/{files.COMMITTED}")
    for target in range(3):
        assert lines_of(spark, tmp_path, target) == expected_lines(target)
