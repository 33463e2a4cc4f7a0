"""Text to lines.

A record ends at ``\\n`` and nowhere else; one ``\\r`` before it belongs to the
terminator.  Empty lines, trailing blanks, tabs, quotes and interior ``\\r``
stay.  The last record counts even without its ``\\n``, and then keeps a final
``\\r``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_lines(df: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """Split a text column into ``(keys…, line_no, line)``, counting from 0.

    The text is trimmed to its records before it is split, so that nothing but
    the keys travels along with the exploded lines.
    """
    text = F.replace(F.col(content), F.lit("\r\n"), F.lit("\n"))
    records = F.when(
        text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)
    ).otherwise(text)
    return (
        df.filter(F.col(content) != "")
        .select(*keys, F.posexplode(F.split(records, "\n")).alias("_pos", "line"))
        .select(*keys, F.col("_pos").cast("bigint").alias("line_no"), "line")
    )


def strip_cr(record: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.when(
        record.endswith("\r"), F.substring(record, F.lit(1), F.length(record) - 1)
    ).otherwise(record)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read whole files as ``(path, block, seq, line)``.

    Files are split into byte ranges by the built-in reader.  ``(block, seq)``
    orders the lines of a file: where the range starts, then the position
    within it.  The built-in reader does not tell whether the last record was
    terminated, so a final ``\\r`` without ``\\n`` is dropped too.
    """
    raw = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        strip_cr(F.col("value")).alias("line"),
    )


def flag_invalid(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add ``quarantined``: whether the line is not valid UTF-8."""
    return lines.withColumn("quarantined", ~F.is_valid_utf8(F.col(column)))


def split_valid(lines: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """Separate valid lines from quarantined ones; no row is lost."""
    flagged = flag_invalid(lines, column)
    return (
        flagged.filter(~F.col("quarantined")).drop("quarantined"),
        flagged.filter("quarantined").drop("quarantined"),
    )
