"""Exact top-k search by inner product, in tiles.

Rows are cut into shards where they lie and queries into blocks.  A task
multiplies a block with its shard as matrices, keeps the best ``k`` of each
query in that tile, and the lists of all tiles are merged in a tree.

Components become ``floor(scale * x)``, so that scores are integers.  Vectors
that are NULL, or hold a NULL or non-finite component, take no part; vectors
are compared with those of the same length only.  Ties go to the smaller id.
Repeated ids are separate candidates, and a query never meets rows of its own
id.  Every row of a repeated query id is searched, exact repeats too, and the
best rows of all of them are the list of that id.  Scores beyond 64 bits are set to the nearest 64-bit value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, written

SCALE = 1024
QUERY_BLOCK = 2048
SHARD_ROWS = 8192
FAN_IN = 16

# Whole numbers below this are exact in a double, and so are their sums.
_EXACT = 1 << 53
_INT64 = np.iinfo(np.int64)

_TILE = "query_id bigint, vec_id bigint, score bigint, leaf bigint"


def scaled(values: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows that take part, by vector length: positions, components times ``scale``."""
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.values.slice(values.offsets[0].as_py(), int(sizes.sum()))
    numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[valid]).tolist():
        rows = np.flatnonzero(valid & (sizes == size))
        parts = numbers[begins[rows][:, None] + np.arange(size)[None, :]]
        whole = np.isfinite(parts).all(axis=1)
        if whole.any():
            out[size] = (rows[whole], np.floor(parts[whole] * scale))
    return out


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    if not queries.size or not shard.size:
        return np.zeros((len(queries), len(shard)), dtype=np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(shard).max()) * queries.shape[1]
    if bound < _EXACT:
        return (queries @ shard.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side] for side in (queries, shard)]
    out = [
        [min(_INT64.max, max(-_INT64.max, sum(map(int.__mul__, q, v)))) for v in whole[1]]
        for q in whole[0]
    ]
    return np.array(out, dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """The ``k`` best rows per query: ``(query position, row position)``.

    All rows that tie with the k-th are kept until ids decide.
    """
    n = scores.shape[1]
    allowed = ids[None, :] != own[:, None]
    if n > k + 1:
        # One row of the query's own id may stand among the first k + 1.
        copies = max(1, int(np.unique(ids, return_counts=True)[1].max()))
        cut = min(n - 1, k + copies - 1)
        least = -np.partition(-scores, cut, axis=1)[:, cut]
        allowed &= scores >= least[:, None]
    at, row = np.nonzero(allowed)
    order = np.lexsort((ids[row], -scores[at, row], at))
    at, row = at[order], row[order]
    starts = np.searchsorted(at, at, side="left")
    chosen = np.arange(len(at)) - starts < k
    return at[chosen], row[chosen]


def _tiles(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        leaf = 0
        for batch in slices(batches, SHARD_ROWS):
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            leaf = leaf or int(ids[0])
            for size, (rows, shard) in scaled(batch.column("embedding"), scale).items():
                if size in queries:
                    top = tile(*queries[size], ids[rows].astype(np.int64), shard)
                    tops[size] = top if size not in tops else joined(tops[size], top)
        for size, (at, vec_id, score) in tops.items():
            own = queries[size][0][at]
            own, vec_id, score = first(own, vec_id, score)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own),
                    pa.array(vec_id),
                    pa.array(score),
                    pa.array(np.full(len(own), leaf)),
                ],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    def tile(own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, shard: np.ndarray):
        parts = []
        for first in range(0, len(own), 256):
            part = slice(first, first + 256)
            scores = products(vectors[part], shard)
            at, row = best(scores, ids, own[part], k)
            parts.append((at + first, ids[row], scores[at, row]))
        return tuple(np.concatenate(column) for column in zip(*parts))

    def joined(one, other):
        return first(*(np.concatenate(pair) for pair in zip(one, other)))

    def first(at, vec_id, score):
        order = np.lexsort((vec_id, -score, at))
        at = at[order]
        chosen = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
        return at[chosen], vec_id[order][chosen], score[order][chosen]

    return run


def _first(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` of each key; partial lists are cut before they move on."""
    order = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))
    )
    return (
        lists.groupBy("query_id", *keys)
        .agg(F.slice(order, 1, k).alias("top"))
        .select("query_id", *keys, F.posexplode("top").alias("place", "hit"))
        .select("query_id", *keys, "place", "hit.vec_id", "hit.score")
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have ``vec_id`` and ``embedding``.  Returns ``query_id, rank, vec_id,
    score``; ``rank`` starts from 1.  Queries are numbered in blocks of at
    most about ``query_block`` rows, the unit that is sent to every shard.
    """
    vectors = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")
    ).filter("vec_id is not null")
    queries = queries.select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")
    ).filter("vec_id is not null and embedding is not null")
    blocks = max(1, -(-queries.count() // max(1, query_block // 2)))
    placed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)))
    if blocks > 1:
        placed = written(placed.repartition(blocks, "block"), "query-blocks")
    found = None
    for block in range(blocks):
        tile = vectors.mapInArrow(
            _tiles(_block(placed.filter(F.col("block") == block), scale), k, scale), _TILE
        )
        merged = _merge(tile, k)
        if blocks > 1:
            merged = written(merged, "top-lists")
        found = merged if found is None else found.unionByName(merged)
    # Rows of one query id may lie in several blocks.
    return _ranked(found, k) if blocks > 1 else found


def _block(rows: DataFrame, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Queries of one block by vector length: ids and scaled components."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in rows.select("vec_id", "embedding").toArrow().to_batches():
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for size, (kept, vectors) in scaled(batch.column("embedding"), scale).items():
            earlier = found.get(size, (ids[:0], vectors[:0]))
            found[size] = (
                np.concatenate((earlier[0], ids[kept])),
                np.concatenate((earlier[1], vectors)),
            )
    return {size: (ids.astype(np.int64), vectors) for size, (ids, vectors) in found.items()}


def _merge(tiles: DataFrame, k: int) -> DataFrame:
    """Lists of all tiles to one list per query, ``FAN_IN`` nodes at a time."""
    node = F.pmod(F.xxhash64("leaf"), F.lit(FAN_IN * FAN_IN))
    level = _first(tiles.withColumn("node", node), k, "node")
    level = _first(level.withColumn("node", F.col("node") % FAN_IN), k, "node")
    return _ranked(level, k)


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    return _first(lists, k).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "vec_id", "score"
    )
