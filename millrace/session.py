"""Session helpers: shared scratch space and size-checked joins."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count shows it within both limits.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 * 1024 * 1024

# Copies of a side that is too large to broadcast: a key that holds a third
# of all rows is spread over this many tasks.
SALTS = 64


_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors of ``spark``.

    Needed once per application unless the package is installed there or was
    given to ``spark-submit --py-files``.
    """
    context = spark.sparkContext
    if context.applicationId not in _attached:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace")
        context.addPyFile(
            shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        )
        _attached.add(context.applicationId)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The setting names the shared folder of a cluster.  Only a local session
    may go without it and then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what is read more than once."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """File system and path object, so that every folder Spark can use works."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and host, as any process of the cluster can use it."""
    filesystem, place = _hadoop(spark, path)
    uri = filesystem.makeQualified(place).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if not uri.startswith("file:///") else uri


def make_folder(spark: SparkSession, path: str) -> None:
    filesystem, place = _hadoop(spark, path)
    filesystem.mkdirs(place)


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Move the part files of a folder into another one of the same store.

    They come under ``prefix`` and their own names, each at once.  What was moved
    before is no longer there, so an interrupted move can be repeated.
    """
    filesystem, place = _hadoop(spark, source)
    if not filesystem.exists(place):
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    moved = 0
    for status in filesystem.listStatus(place):
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if not filesystem.rename(status.getPath(), hadoop(f"{target}/{prefix}-{name}")):
            raise OSError(f"cannot move {status.getPath()} to {target}")
        moved += 1
    return moved


def is_written(spark: SparkSession, table: str) -> bool:
    """Whether a table folder holds a completed write."""
    filesystem, place = _hadoop(spark, f"{table}/_SUCCESS")
    return filesystem.exists(place)


def is_marked(spark: SparkSession, path: str) -> bool:
    filesystem, place = _hadoop(spark, path)
    return filesystem.exists(place)


def mark(spark: SparkSession, path: str) -> None:
    """Leave an empty file."""
    filesystem, place = _hadoop(spark, path)
    filesystem.create(place, True).close()


def folder_names(spark: SparkSession, path: str) -> list[str]:
    filesystem, place = _hadoop(spark, path)
    if not filesystem.exists(place):
        return []
    return [status.getPath().getName() for status in filesystem.listStatus(place)]


def drop_folder(spark: SparkSession, path: str) -> None:
    filesystem, place = _hadoop(spark, path)
    filesystem.delete(place, True)


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether ``df`` is within the broadcast limits.

    Counts rows and bytes where the rows are and brings two numbers to the
    driver, so that asking about a large table does no harm either.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def join_checked(
    lines: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    condition: Column | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Equi-join a large line table with a configuration-sized side.

    A side that passes :func:`is_small` is broadcast.  A larger one is copied
    once per salt and the lines get a salt from ``spread``, so that no key ends
    up in a single task.  ``condition`` is an extra test, allowed for semi and
    anti joins, written with the aliases ``l`` and ``r``.
    """
    keys = list(on)
    if small is None:
        small = is_small(side)
    if small:
        side = F.broadcast(side)
    else:
        spread = list(spread or lines.columns)
        lines = lines.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
        side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys.append("_salt")
    if condition is None:
        joined = lines.join(side, keys, how)
    else:
        equal = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
        joined = lines.alias("l").join(side.alias("r"), [*equal, condition], how)
    return joined.drop("_salt")
