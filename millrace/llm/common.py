"""What the operators of this package share: Arrow passes, hashes, tables.

An operator adds columns to the rows it is given and keeps the others.  A
result column takes the place of an input column of the same name.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import scratch_dir

# Rows a task works on at a time, so that memory follows the text in a few rows.
ROWS_AT_ONCE = 512
# The same in bytes of text, for operators whose memory is a multiple of them.
BYTES_AT_ONCE = 1 << 21
# Bytes of an Arrow batch on its way to a task; Spark counts rows only, by default.
BATCH_BYTES = 1 << 22
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table that a query needs."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def add_columns(
    df: DataFrame,
    ddl: str,
    task: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    bounded: str | None = None,
    size: int = BYTES_AT_ONCE,
) -> DataFrame:
    """Add the columns ``ddl`` to every row.

    ``task()`` is called once per task and gives the function that computes
    the new columns of a slice of rows; if that has ``close``, it is called
    when the task is through.  With ``bounded``, the name of a text
    column, slices are cut at ``size`` bytes of it instead of by rows.
    """
    added = StructType.fromDDL(ddl)
    taken = {field.name.lower() for field in added}
    kept = [i for i, field in enumerate(df.schema) if field.name.lower() not in taken]
    schema = StructType([df.schema[i] for i in kept] + added.fields)
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = task()
        cut = slices_by_size(batches, bounded, size) if bounded else slices(batches)
        for batch in cut:
            columns = [batch.column(i) for i in kept] + work(batch)
            yield pa.RecordBatch.from_arrays(columns, names=names)
            del columns
        getattr(work, "close", lambda: None)()

    return pass_through(df, run, schema)


def pass_through(
    df: DataFrame,
    run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: StructType | str,
) -> DataFrame:
    """``mapInArrow`` whose tasks give back at their end what they no longer use."""
    bound_batches(df.sparkSession)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own.

    An executor holds a batch several times over, outside its heap; of long texts,
    the rows of a batch are tens of megabytes.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def give_back() -> None:
    """Return free memory; a worker lives on, and what its allocators keep counts as used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices_by_size(
    batches: Iterable[pa.RecordBatch], column: str, size: int, rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where a text column comes to ``size`` bytes; at least one row each."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = np.diff(flat_bytes(batch.column(at))[1])
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(lengths[start : start + rows])
            n = max(1, int(np.searchsorted(ends, size, side="right")))
            yield batch.slice(start, n)
            start += n


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; NULL is empty."""
    data, ends = flat_bytes(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind each other, and where each begins (one entry more)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)
    ends = ends[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: short lineage, computed once."""
    bound_batches(df.sparkSession)
    spark, schema = df.sparkSession, df.schema
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """:func:`stored`, and what was shuffled for it goes at once."""
    spark, out = df.sparkSession, stored(df, label)
    del df
    # What the finished steps shuffled is deleted once the driver's references
    # to it are collected; on an idle driver that can take long.  Listeners hold
    # the last query for a moment.
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


def held_out(column: str, parts: int, part: int):
    """Whether ``crc32`` of the id as text leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def shared_rows(rows: DataFrame, hot: int | None = None) -> DataFrame:
    """Rows ``(key, doc, …)`` whose key another row has too.

    With ``hot``, a key of more rows than that also gets a row without ``doc``.

    Rows arrive sorted by key and pass by; only the last one is held back.  A
    key has at most one row per document, a small part of a document's rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        held_shared, length = False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if hot is not None:
                at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                lengths = np.diff(np.append(at, len(keys)))
                if held is not None and held.column("key")[0].as_py() == keys[0]:
                    lengths[0] += length
                elif length > hot:
                    yield mark(held)
                for i in np.flatnonzero(lengths[:-1] > hot).tolist():
                    yield mark(batch.slice(int(at[i]), 1))
                length = int(lengths[-1])
            same = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
            if held is not None:
                same[0] = held.column("key")[0].as_py() == keys[0]
                if held_shared or same[0]:
                    yield held
            shared = same[:-1] | same[1:]
            held, held_shared = batch.slice(len(keys) - 1), bool(shared[-1])
            yield batch.filter(pa.array(np.concatenate((shared[:-1], [False]))))
        if held is not None and held_shared:
            yield held
        if hot is not None and length > hot:
            yield mark(held)

    def mark(row: pa.RecordBatch) -> pa.RecordBatch:
        at = row.schema.get_field_index("doc")
        return row.set_column(at, row.schema.field(at), pa.nulls(1, row.schema.field(at).type))

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return pass_through(ordered, run, rows.schema)
