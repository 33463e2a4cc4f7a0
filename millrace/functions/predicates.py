"""Keep/drop predicates over a line column."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.patterns import literal_form, pattern_problem, to_java_pattern

# Names of groups are of no use here, and may not repeat in an alternation.
GROUP_NAME = r"\(\?<[A-Za-z][A-Za-z0-9]*>"


def found(line: Column, pattern: str) -> Column:
    """True when ``pattern`` is found anywhere in the line.

    Patterns that are plain text become byte comparisons; the others become
    ``RLIKE`` with a literal, compiled once per task.
    """
    to_java_pattern(pattern)
    literal = literal_form(pattern)
    if literal is None:
        return line.rlike(to_java_pattern(pattern))
    kind, text = literal
    if kind == "contains":
        return line.contains(text)
    if kind == "startswith":
        return line.startswith(text)
    if kind == "endswith":
        return line.endswith(text)
    return line == F.lit(text)


def any_found(line: Column, patterns: Sequence[str]) -> Column:
    """True when at least one pattern is found; false for no patterns.

    Several patterns become one alternation, so that a long list is one small
    expression.
    """
    if not patterns:
        return F.lit(False)
    if len(patterns) == 1:
        return found(line, patterns[0])
    plain = [re.sub(GROUP_NAME, "(", to_java_pattern(p)) for p in patterns]
    return line.rlike("|".join(f"(?:{p})" for p in plain))


def matches_allow_list(line: Column, match_on: Sequence[str]) -> Column:
    """Allow-list test: an empty list lets every line through."""
    return any_found(line, match_on) if match_on else F.lit(True)


def passes_deny_list(line: Column, exclude_on: Sequence[str]) -> Column:
    """Deny-list test: an empty list drops nothing."""
    return ~any_found(line, exclude_on) if exclude_on else F.lit(True)


def is_passthrough(match_on: Sequence[str], exclude_on: Sequence[str]) -> bool:
    """Whether the pair of lists lets every line through by definition."""
    return not match_on and not exclude_on


def ship_predicate(
    match_on: Sequence[str], exclude_on: Sequence[str], line: Column | None = None
) -> Column:
    """Allow-list and not deny-list; the deny-list wins."""
    line = F.col("line") if line is None else line
    if is_passthrough(match_on, exclude_on):
        return F.lit(True)
    if not exclude_on:
        return matches_allow_list(line, match_on)
    if not match_on:
        return passes_deny_list(line, exclude_on)
    return matches_allow_list(line, match_on) & passes_deny_list(line, exclude_on)


def ship_predicate_from_columns(
    line: Column, match_on: Column, exclude_on: Column
) -> Column:
    """The same test with the translated patterns held in array columns.

    Used when there are too many rules to spell out as literals.
    """
    allowed = (F.size(match_on) == 0) | F.exists(match_on, lambda p: F.rlike(line, p))
    denied = F.exists(exclude_on, lambda p: F.rlike(line, p))
    return allowed & ~denied


@F.pandas_udf(T.ArrayType(T.StringType()))
def java_patterns(patterns: pd.Series) -> pd.Series:
    """Translate every pattern of an array column (route tables only)."""
    return patterns.map(
        lambda row: None if row is None else [to_java_pattern(p) for p in row]
    )


@F.pandas_udf(T.StringType())
def first_bad_pattern(patterns: pd.Series) -> pd.Series:
    """``'<pattern>': <reason>`` for the first unusable pattern, else NULL."""

    def problem(row) -> str | None:
        for pattern in row if row is not None else ():
            reason = pattern_problem(pattern)
            if reason is not None:
                return f"'{pattern}': {reason}"
        return None

    return patterns.map(problem)
