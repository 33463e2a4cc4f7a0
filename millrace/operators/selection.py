"""Line selection, entry projection and keep/drop accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import is_passthrough, ship_predicate


def select_lines(
    lines: DataFrame, match_on: Sequence[str] = (), exclude_on: Sequence[str] = ()
) -> DataFrame:
    """Keep the lines one pair of lists ships; no filter node when both are empty."""
    if is_passthrough(match_on, exclude_on):
        return lines
    return lines.filter(ship_predicate(match_on, exclude_on))


def passthrough_flag(match_on: Column, exclude_on: Column) -> Column:
    """Whether a row of the routes table filters nothing."""
    return (F.size(match_on) == 0) & (F.size(exclude_on) == 0)


def to_entries(shipped: DataFrame) -> DataFrame:
    """Project to the record that leaves the system, with its order key."""
    return shipped.select("route_id", "offset", "path", "line")


def ship_accounting(
    lines: DataFrame, match_on: Sequence[str], exclude_on: Sequence[str]
) -> DataFrame:
    """Kept and dropped line counts per path, aggregated before the shuffle."""
    keep = ship_predicate(match_on, exclude_on)
    return (
        lines.select("path", keep.alias("keep"))
        .groupBy("path")
        .agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))
    )
