"""Fan lines out over the routes table and apply each route's rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import (
    GROUP_NAME,
    java_patterns,
    ship_predicate,
    ship_predicate_from_columns,
)
from millrace.session import is_small, join_checked

def route_lines(lines: DataFrame, routes: DataFrame, small: bool | None = None) -> DataFrame:
    """Give every line to every route on its path; other lines go nowhere.

    Adds ``route_id`` and ``polling_frequency_ms``.
    """
    targets = routes.select("path", "route_id", "polling_frequency_ms")
    return join_checked(lines, targets, ["path"], small=small)


def apply_rules(routed: DataFrame, routes: DataFrame, small: bool | None = None) -> DataFrame:
    """Keep the lines that pass the rules of their own route."""
    rules = routes.select("route_id", "match_on", "exclude_on")
    if small is None:
        small = is_small(rules)
    if small:
        return routed.filter(literal_rules(rules))
    translated = rules.select(
        "route_id",
        java_patterns("match_on").alias("_match"),
        java_patterns("exclude_on").alias("_exclude"),
    )
    joined = join_checked(routed, translated, ["route_id"], small=small)
    keep = ship_predicate_from_columns(F.col("line"), F.col("_match"), F.col("_exclude"))
    return joined.filter(keep).drop("_match", "_exclude")


def literal_rules(rules: DataFrame) -> Column:
    """One predicate over ``route_id`` and ``line`` for a rule table of checked size.

    Routes with the same rules share a branch, and a list of patterns is one
    alternation.
    """
    shared: dict[tuple, list[int]] = {}
    for row in rules.collect():
        key = (tuple(row["match_on"]), tuple(row["exclude_on"]))
        shared.setdefault(key, []).append(row["route_id"])
    branches = [
        F.col("route_id").isin(ids) & ship_predicate(match_on, exclude_on)
        for (match_on, exclude_on), ids in shared.items()
    ]
    return reduce(lambda a, b: a | b, branches, F.lit(False))


def ship_lines(lines: DataFrame, routes: DataFrame, small: bool | None = None) -> DataFrame:
    """Fan-out followed by the per-route rules."""
    small = is_small(routes) if small is None else small
    return apply_rules(route_lines(lines, routes, small), routes, small)


def _alternations(patterns: DataFrame) -> DataFrame:
    """One pattern per route that finds what any of its patterns finds."""
    plain = F.regexp_replace("pattern", GROUP_NAME, "(")
    wrapped = F.concat(F.lit("(?:"), plain, F.lit(")"))
    return patterns.groupBy("route_id").agg(
        F.concat_ws("|", F.collect_list(wrapped)).alias("_pattern")
    )


def allow_lines(routed: DataFrame, patterns: DataFrame, routes: DataFrame) -> DataFrame:
    """Allow-list held in a table ``(route_id, pattern)`` of translated patterns.

    A line stays when a pattern of its route is found, which is one test per
    line.  A route without any pattern gets the empty one, found in every line.
    """
    wanted = (
        routes.select("route_id")
        .join(_alternations(patterns), "route_id", "left")
        .select("route_id", F.coalesce("_pattern", F.lit("")).alias("_pattern"))
    )
    joined = join_checked(routed, wanted, ["route_id"])
    return joined.filter(F.rlike("line", F.col("_pattern"))).drop("_pattern")


def deny_lines(routed: DataFrame, patterns: DataFrame) -> DataFrame:
    """Deny-list held in a table ``(route_id, pattern)`` of translated patterns."""
    joined = join_checked(routed, _alternations(patterns), ["route_id"], "left")
    kept = ~F.coalesce(F.rlike("line", F.col("_pattern")), F.lit(False))
    return joined.filter(kept).drop("_pattern")
