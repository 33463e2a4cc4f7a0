from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.predicates import is_passthrough, java_patterns, ship_predicate
from millrace.operators import routing as R
from millrace.operators.selection import select_lines, ship_accounting
from millrace.plans.routes import normalize_routes, routes_table

# match_on, exclude_on, shipped lines, dropped lines
CASES = [
    ([], [], ["", "cat", "  x  "], []),
    (["disk", "fan$"], [], ["disk full", "low disk", "broken fan"], ["fan speed", "", "Disk"]),
    ([], ["^#", "noise"], ["a # b", ""], ["# note", "some noise", "noise"]),
    (["pump", "valve"], ["idle"], ["pump on", "valve 3"], ["pump idle", "idle valve", "motor"]),
    ([r"^\w+=\d{2,}$", r"(?P<a>k)v"], [r"=0\d"], ["speed=120", "kv"], ["speed=1", "n=007", "x speed=12"]),
]


def lines_of(spark, case, path="/a"):
    rows = [(path, i, line) for i, line in enumerate(case[2] + case[3])]
    return spark.createDataFrame(rows, "path string, offset long, line string")


@pytest.mark.parametrize("case", CASES)
def test_lines_kept_and_dropped(spark, case):
    match_on, exclude_on, kept, _ = case
    lines = lines_of(spark, case)
    got = [r["line"] for r in select_lines(lines, match_on, exclude_on).orderBy("offset").collect()]
    assert got == kept
    counts = ship_accounting(lines, match_on, exclude_on).first()
    assert (counts["kept"], counts["dropped"]) == (len(kept), len(case[3]))


def test_passthrough():
    assert is_passthrough([], [])
    assert not is_passthrough(["a"], [])
    assert not is_passthrough([], ["a"])


def test_no_filter_node_for_passthrough(spark):
    lines = lines_of(spark, CASES[0])
    assert select_lines(lines) is lines


def test_invalid_pattern_is_refused_eagerly():
    with pytest.raises(ValueError):
        ship_predicate(["[invalid"], [])


@pytest.fixture
def routed_case(spark):
    """All cases at once: two routes share the path of case 1."""
    routes, lines = [], None
    for i, case in enumerate(CASES):
        routes.append({"path": f"/{i}", "match_on": case[0], "exclude_on": case[1]})
        part = lines_of(spark, case, f"/{i}")
        lines = part if lines is None else lines.unionByName(part)
    routes.append({"path": "/1", "match_on": None, "exclude_on": ["speed"]})
    rows = [
        {"route_id": i, "polling_frequency_ms": 500, "destination": {"type": "file", "path": "/o"}, **r}
        for i, r in enumerate(routes)
    ]
    other = spark.createDataFrame([("/none", 0, "disk")], lines.schema)
    expected = {(i, line) for i, case in enumerate(CASES) for line in case[2]}
    expected |= {(5, line) for line in CASES[1][2] + CASES[1][3] if "speed" not in line}
    return lines.unionByName(other), normalize_routes(routes_table(spark, rows)), expected


@pytest.mark.parametrize("small", [True, False])
def test_fan_out_and_rules(routed_case, small):
    """Broadcast with literal rules, and salted shuffles with rules in columns."""
    lines, routes, expected = routed_case
    shipped = R.ship_lines(lines, routes, small).collect()
    assert len(shipped) == len(expected)
    assert {(r["route_id"], r["line"]) for r in shipped} == expected


def test_rules_in_tables(routed_case, monkeypatch):
    lines, routes, expected = routed_case
    routed = R.route_lines(lines, routes)

    def table(column):
        return routes.select("route_id", F.explode(java_patterns(column)).alias("pattern"))

    for rows in (1, 0):  # broadcast, then salted
        monkeypatch.setattr(
            "millrace.session.is_small", lambda df, max_rows=rows, max_bytes=1: max_rows > 0
        )
        shipped = R.deny_lines(
            R.allow_lines(routed, table("match_on"), routes), table("exclude_on")
        ).collect()
        assert len(shipped) == len(expected)
        assert {(r["route_id"], r["line"]) for r in shipped} == expected


def test_many_patterns_are_one_expression(spark):
    lines = spark.createDataFrame([("/a", 0, "word7x"), ("/a", 1, "none")], "path string, offset long, line string")
    rule = ship_predicate([f"word{i}[a-z]" for i in range(500)], [])
    assert [r["line"] for r in lines.filter(rule).collect()] == ["word7x"]
