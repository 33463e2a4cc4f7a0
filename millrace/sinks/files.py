"""JSON Lines output.

A destination path becomes a directory of part files.  Appending batches adds
part files and never rewrites earlier ones.

An append is a transaction over all file routes: one Spark job writes their
entries to a staged table, partitioned by route, and once that is complete its
files are moved to the directories they are for.  Readers see whole files only.  A
transaction has a log entry; until that is made it can be repeated at any point and
goes on where it was, and afterwards repeating it appends nothing.
"""

from __future__ import annotations

import hashlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import (
    drop_folder,
    folder_names,
    is_marked,
    is_written,
    make_folder,
    mark,
    move_files,
    qualified,
)

ENTRY_SCHEMA = "path string, line string"
COMMITTED = "_COMMITTED"


def prepare_file_routes(spark: SparkSession, routes: DataFrame) -> None:
    """Create the output of every file route, even if nothing will ship to it."""
    for target in {target for _, target in file_targets(routes)}:
        make_folder(spark, target)
        mark(spark, f"{target}/_SUCCESS")


def file_targets(routes: DataFrame) -> list[tuple[int, str]]:
    """``(route_id, directory)`` of the file routes: a row of the settings each."""
    rows = (
        routes.filter(F.col("destination.type") == "file")
        .select("route_id", F.col("destination.path").alias("target"))
        .collect()
    )
    return [(row["route_id"], row["target"]) for row in rows]


def write_entries(entries: DataFrame, target: str) -> None:
    """Append ``(path, line)`` records."""
    entries.select("path", "line").write.mode("append").json(target)


def write_file_routes(batches: DataFrame, routes: DataFrame, log_dir: str) -> None:
    """Append the batches of all file routes to their outputs, once.

    ``batches`` should be a table written with ``partitionBy("route_id")``: the
    job then reads the partitions of file routes and nothing else.  ``log_dir`` names the
    transaction and holds its log entry.  Lines follow each other as in their
    batches, batches of a file by number.

    Files cannot be moved from one store to another, so there is one job per
    store; routes commonly share one.
    """
    spark = batches.sparkSession
    targets = file_targets(routes)
    if not targets or is_marked(spark, f"{log_dir}/{COMMITTED}"):
        return
    name = hashlib.sha256(log_dir.encode()).hexdigest()[:16]
    stores: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for route_id, target in targets:
        uri = qualified(spark, target)
        place = urlsplit(uri)
        stores.setdefault((place.scheme, place.netloc), []).append((route_id, uri))
    for of_store in stores.values():
        # Hidden from readers of the directory it is in.
        staged = f"{min(of_store)[1]}/_staged-{name}"
        if not is_written(spark, staged):
            _stage(batches, [route_id for route_id, _ in of_store], staged)
        folders = set(folder_names(spark, staged))
        for route_id, target in of_store:
            if f"route_id={route_id}" in folders:
                make_folder(spark, target)
                move_files(spark, f"{staged}/route_id={route_id}", target, f"{name}-{route_id}")
    mark(spark, f"{log_dir}/{COMMITTED}")
    for of_store in stores.values():
        drop_folder(spark, f"{min(of_store)[1]}/_staged-{name}")


def _stage(batches: DataFrame, route_ids: list[int], staged: str) -> None:
    entries = batches.filter(F.col("route_id").isin(route_ids)).select(
        "route_id", "batch_id", "part", F.posexplode("entries").alias("at", "entry")
    )
    ordered = entries.sortWithinPartitions("route_id", "batch_id", "part", "at")
    lines = ordered.select("route_id", "entry.path", "entry.line")
    lines.write.mode("overwrite").partitionBy("route_id").json(staged)
