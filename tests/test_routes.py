from __future__ import annotations

import textwrap

import pytest

from millrace.plans import routes as P

MINIMAL = """
log_files:
  - path: "/srv/app/out.txt"
    polling_frequency_ms: 750
    destination: {type: "http", endpoint: "https://sink.example/in"}
"""


def parse(spark, text):
    return P.parse_routes(spark, textwrap.dedent(text)).orderBy("route_id").collect()


def entry(destination, extra=""):
    return f"""
log_files:
  - path: /srv/app/out.txt
    polling_frequency_ms: 750
    destination: {destination}
    {extra}
"""


def test_defaults(spark):
    (route,) = parse(spark, MINIMAL)
    assert route["path"] == "/srv/app/out.txt"
    assert route["polling_frequency_ms"] == 750
    assert (route["buffer_size"], route["flush_interval_ms"]) == (100, 30_000)
    assert (route["match_on"], route["exclude_on"]) == ([], [])
    assert route["destination"]["type"] == "http"


def test_custom_buffering_and_filters(spark):
    (route,) = parse(
        spark,
        entry(
            "{type: http, endpoint: 'http://x'}",
            "buffer_size: 7\n    flush_interval_ms: 1234\n"
            "    match_on: [pump, fan]\n    exclude_on: [idle]",
        ),
    )
    assert (route["buffer_size"], route["flush_interval_ms"]) == (7, 1234)
    assert (route["match_on"], route["exclude_on"]) == (["pump", "fan"], ["idle"])


def test_destinations_keep_their_fields(spark):
    (http,) = parse(
        spark,
        entry(
            "{type: http, endpoint: 'http://e', require_auth: true, api_key: k-77,"
            " basic: {username: ann, password: p4ss}}"
        ),
    )
    dest = http["destination"]
    assert (dest["endpoint"], dest["require_auth"], dest["api_key"]) == ("http://e", True, "k-77")
    assert tuple(dest["basic"]) == ("ann", "p4ss")
    (syslog,) = parse(spark, entry("{type: syslog, host: h, port: 6514, protocol: tcp}"))
    assert tuple(syslog["destination"][k] for k in ("host", "port", "protocol")) == ("h", 6514, "tcp")
    (plain,) = parse(spark, entry("{type: syslog, host: h}"))
    assert tuple(plain["destination"][k] for k in ("port", "protocol")) == (514, "udp")
    (search,) = parse(spark, entry("{type: elasticsearch, url: 'http://e:9200', index: i}"))
    assert (search["destination"]["url"], search["destination"]["index"]) == ("http://e:9200", "i")
    (file,) = parse(spark, entry("{type: file, path: /keep/out}"))
    assert file["destination"]["path"] == "/keep/out"


def test_order_is_kept_and_an_empty_list_is_legal(spark):
    text = "log_files:\n" + "".join(
        f"  - {{path: /{n}, polling_frequency_ms: 1, destination: {{type: file, path: /o}}}}\n"
        for n in "cab"
    )
    assert [(r["route_id"], r["path"]) for r in parse(spark, text)] == [(0, "/c"), (1, "/a"), (2, "/b")]
    assert parse(spark, "log_files: []") == []


def test_yaml_scalars_and_unknown_keys(spark):
    (route,) = parse(
        spark, entry("{type: syslog, host: yes, protocol: on}", "match_on: [2024-01-01, off]\n    extra: 1")
    )
    assert route["destination"]["host"] == "yes"
    assert route["destination"]["protocol"] == "on"
    assert route["match_on"] == ["2024-01-01", "off"]


@pytest.mark.parametrize(
    "text",
    [
        "invalid: yaml: syntax: [[[",
        "[]",
        "other: 1",
        "log_files: {}",
        "log_files:\n  - {path: /a, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1}",
        "log_files:\n  - {path: 1, polling_frequency_ms: 1, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: '1', destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: -1, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1.5, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: true, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1, destination: {endpoint: x}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1, match_on: ERROR, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1, match_on: null, destination: {type: file}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1, destination: {type: syslog, port: 70000}}",
        "log_files:\n  - {path: /a, polling_frequency_ms: 1, destination: {type: http, basic: {username: u}}}",
        "log_files:\n  - {path: /a, path: /b, polling_frequency_ms: 1, destination: {type: file}}",
    ],
)
def test_unusable_configurations_fail_as_a_whole(spark, text):
    with pytest.raises(P.ConfigError):
        P.parse_routes(spark, text)


def test_loading_from_a_file(spark, tmp_path):
    path = tmp_path / "routes.yaml"
    path.write_text(MINIMAL)
    assert P.load_routes(spark, str(path)).count() == 1
    with pytest.raises(P.ConfigError):
        P.load_routes(spark, str(tmp_path / "none.yaml"))


CHECKS = [
    ({"type": "http", "endpoint": "http://e"}, {}, None),
    ({"type": "http"}, {}, P.NO_ENDPOINT),
    ({"type": "http", "endpoint": "e", "require_auth": True}, {}, P.NO_CREDENTIALS),
    ({"type": "http", "endpoint": "e", "require_auth": True, "api_key": ""}, {}, P.NO_CREDENTIALS),
    ({"type": "http", "endpoint": "e", "require_auth": True, "api_key": "k"}, {}, None),
    ({"type": "http", "endpoint": "e", "api_key": "a\nb"}, {}, "failed to parse header value"),
    ({"type": "syslog", "host": "h"}, {}, None),
    ({"type": "syslog", "host": "h", "protocol": "TCP"}, {}, None),
    ({"type": "syslog", "host": "h", "protocol": "icmp"}, {},
     "Invalid syslog protocol: icmp (use 'udp' or 'tcp')"),
    ({"type": "syslog"}, {}, P.NO_HOST),
    ({"type": "elasticsearch", "index": "i"}, {}, P.NO_URL),
    ({"type": "elasticsearch", "url": "u"}, {}, P.NO_INDEX),
    ({"type": "elasticsearch", "url": "u", "index": "i"}, {}, None),
    ({"type": "file", "path": "/o"}, {}, None),
    ({"type": "file"}, {}, P.NO_FILE_PATH),
    ({"type": "unknown"}, {}, "Unknown destination type: unknown"),
    ({"type": "unknown"}, {"match_on": ["["]}, "Unknown destination type: unknown"),
    ({"type": "file", "path": "/o"}, {"match_on": ["a", "[invalid"]},
     "Invalid match_on regex '[invalid': unclosed character class"),
    ({"type": "file", "path": "/o"}, {"exclude_on": ["("]}, "Invalid exclude_on regex '(': unclosed group"),
    ({"type": "file", "path": "/o"}, {"polling_frequency_ms": 0},
     "polling_frequency_ms must be at least 1"),
]


def test_validation_skips_bad_routes_and_keeps_the_others(spark):
    rows = [
        {"route_id": i, "path": "/a", "polling_frequency_ms": 500, **extra, "destination": dest}
        for i, (dest, extra, _) in enumerate(CHECKS)
    ]
    routes = P.normalize_routes(P.routes_table(spark, rows))
    got = {r["route_id"]: r["error"] for r in P.validate_routes(routes).collect()}
    assert got == {i: error for i, (_, _, error) in enumerate(CHECKS)}
    valid = {i for i, (_, _, error) in enumerate(CHECKS) if error is None}
    assert {r["route_id"] for r in P.active_routes(routes).collect()} == valid


def test_an_empty_key_hides_basic_credentials(spark):
    dest = {"type": "http", "endpoint": "e", "require_auth": True, "api_key": "",
            "basic": {"username": "u", "password": "p"}}
    row = {"route_id": 0, "path": "/a", "polling_frequency_ms": 1, "destination": dest}
    checked = P.validate_routes(P.normalize_routes(P.routes_table(spark, [row]))).first()
    assert checked["valid"] and checked["warning"]
