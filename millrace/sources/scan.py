"""Change detection for append-only files, as table operators.

``listing(path, inode, size)`` is what is there now and ``cursor(path, inode,
position)`` is what has been read.  The plan says which byte range of which
path is new; the same rules drive the streaming source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import join_checked

from millrace.sources.text import frame_lines

# Outcome of comparing a listing with a cursor.
NEW = "new"
ROTATED = "rotated"
TRUNCATED = "truncated"
APPEND = "append"
IDLE = "idle"
MISSING = "missing"


def plan_scan(listing: DataFrame, cursor: DataFrame, from_start: bool = False) -> DataFrame:
    """Plan one scan: ``(path, action, start_pos, end_pos, new_inode, new_position)``.

    A path without a cursor starts at its end, as does a rotated one, unless
    ``from_start`` asks for a backfill.  The inode is compared before the size.
    A missing path keeps its cursor and is looked at again next time.
    """
    seen = cursor.select(
        "path", F.col("inode").alias("old_inode"), F.col("position").alias("old_position")
    )
    joined = listing.select("path", "inode", "size").join(seen, "path", "full_outer")
    size, position = F.col("size"), F.col("old_position")
    action = (
        F.when(size.isNull(), MISSING)
        .when(position.isNull(), NEW)
        .when(F.col("inode") != F.col("old_inode"), ROTATED)
        .when(size < position, TRUNCATED)
        .when(size > position, APPEND)
        .otherwise(IDLE)
    )
    whole_file = [TRUNCATED, NEW, ROTATED] if from_start else [TRUNCATED]
    reads_whole = F.col("action").isin(*whole_file)
    appended = F.col("action") == APPEND
    return joined.withColumn("action", action).select(
        "path",
        "action",
        F.when(appended, position).when(reads_whole, F.lit(0)).cast("bigint").alias("start_pos"),
        F.when(appended | reads_whole, size).cast("bigint").alias("end_pos"),
        F.coalesce("inode", "old_inode").alias("new_inode"),
        F.coalesce("size", "old_position").alias("new_position"),
    )


def advance_cursor(plan: DataFrame) -> DataFrame:
    """The cursor after the planned ranges have been read."""
    return plan.select(
        "path", F.col("new_inode").alias("inode"), F.col("new_position").alias("position")
    )


def resume_lines(content: DataFrame, plan: DataFrame) -> DataFrame:
    """Frame the planned byte range of ``content(path, text)``.

    Positions count bytes, not characters.  Returns ``(path, line_no, line)``.
    """
    ranges = plan.filter(F.col("start_pos").isNotNull()).select("path", "start_pos", "end_pos")
    # The ranges come to the content, which stays where it is.
    sliced = join_checked(content, ranges, ["path"]).select(
        "path",
        F.substring(
            F.encode("text", "UTF-8"),
            F.col("start_pos").cast("int") + 1,
            (F.col("end_pos") - F.col("start_pos")).cast("int"),
        )
        .cast("string")
        .alias("fresh"),
    )
    return frame_lines(sliced, "fresh", ["path"])
