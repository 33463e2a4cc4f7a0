"""Jaccard self-join of shingle sets with parity sketches.

A set is XOR-hashed into sketches: a token flips the place it is hashed to, so
that tokens two sets share cancel out, and the places in which two sketches
differ are at most as many as the tokens in just one of the sets.  Two sets of
sizes ``a`` and ``b`` with a Jaccard similarity of 3/4 have at most
``(a + b) / 7`` such tokens; other limits work alike.

* *Blocks* find candidates.  The sketch of a size band is cut into more blocks
  than tokens may differ, so that some blocks of a similar pair are equal and
  not empty (pigeonhole).  Sets are joined on equal blocks.  Of the blocks in
  one common order, so many are kept that a similar pair agrees in at least
  ``k`` of them, and a set that shares fewer with any others is done.
* *Bits* sort candidates out: the Hamming distance of two bit sketches bounds
  the difference from below.
* Sets are *verified* from the texts.

Equal sets are joined first and stand for one another.  Members of a block
group are linked to its smallest member; after that only pairs that are not
yet connected are compared.  The smallest member need not be the one that the
others are copies of, so a group with more close pairs than members first has
each member's nearest ones verified only, and then all pairs that these links
leave unconnected: large groups of near copies do not become all their pairs, and
no link between different components is lost.

NULL texts, and texts without words, have empty sets and are linked to nothing.
Rows that occur twice are equal sets.  Rows without an id stay alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import (
    BYTES_AT_ONCE,
    ROWS_AT_ONCE,
    add_columns,
    flat_bytes,
    mix,
    pass_through,
    shared_rows,
    slices,
    slices_by_size,
    written,
)
from millrace.llm.components import components
from millrace.llm.shingles import shingle_sets
from millrace.session import is_small

PERCENT = 75
# Sizes of a band go from a power of this number to below the next.
BAND = 4
# Blocks of a band's largest set hold so many tokens.
TOKENS_PER_BLOCK = 2.2
LEAST_BLOCKS = 16
SEEDS = 16
# Members of a block group that one task compares with as many others.
TILE = 2048
# Rows of block groups that are compared at once; a group is never cut.
GROUPED_ROWS = 4096
# Texts of so many documents are picked out before they are shuffled.
NEEDED_ROWS = 200_000
# Pairs that a task remembers, so as not to give them again.
MAX_SEEN = 200_000

_BITS_MOST, _BITS_LEAST = 2048, 64


def differing(a: int, b: int, percent: int) -> int:
    """Tokens in one set only that two sets of these sizes may have."""
    return (a + b) * (100 - percent) // (100 + percent)


def largest_partner(a: int, percent: int) -> int:
    return a * 100 // percent


def band_of(size: int) -> int:
    band = 0
    while BAND ** (band + 1) <= size:
        band += 1
    return band


def shared_blocks(band: int) -> int:
    """Kept blocks that a similar pair of a band agrees in, at least."""
    return max(1, BAND**band // 16)


def _blocks(tokens: np.ndarray, band: int, seed: int) -> np.ndarray:
    """Values of the blocks that are not empty, as keys of the join, in order."""
    n_blocks = max(LEAST_BLOCKS, int(BAND ** (band + 1) / TOKENS_PER_BLOCK))
    if seed:
        tokens = np.sort(mix(tokens + np.uint64(seed)))
    block = ((tokens >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    firsts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    value = np.bitwise_xor.reduceat(tokens, firsts)
    place = block[firsts] + np.uint64((band * SEEDS + seed) << 40)
    return np.sort(mix(value ^ mix(place))[value != 0])


def block_keys(tokens: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """``(band, keys)`` of a set.

    A set meets partners of its own size band there, and larger ones of the
    next band there.  A set that has too few blocks that are not empty keeps
    all of them and meets others of that kind under another seed.
    """
    size = len(tokens)
    if not size:
        return []
    own, most = band_of(size), largest_partner(size, percent)
    out = []
    for band in (own, own + 1):
        least, limit = BAND**band, BAND ** (band + 1) - 1
        if most < least:
            break
        apart, k = differing(size, min(most, limit), percent), shared_blocks(band)
        for seed in range(SEEDS):
            keys = _blocks(tokens, band, seed)
            if len(keys) >= apart + k:
                out.append((band, keys[: apart + k]))
                break
            out.append((band, keys))
        else:
            # Never seen: sets like this meet in one group of their band.
            out.append((band, mix(np.array([band], dtype=np.uint64))))
    return out


def bit_sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens at each place; wider for larger sets."""
    width = _BITS_LEAST
    while width < min(_BITS_MOST, 4 * len(tokens)):
        width *= 2
    place = (mix(tokens) & np.uint64(width - 1)).astype(np.int64)
    parity = np.bincount(place, minlength=width) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) at a smaller width."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    low = mix(tokens + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    high = mix(tokens ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return np.array([low, high]).tobytes()


def describe_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``n_shingles``, ``digest`` and ``sketch``."""

    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = list(shingle_sets(batch.column(text_col)))
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) for s in sets], pa.binary()),
                pa.array([bit_sketch(s) for s in sets], pa.binary()),
            ]

        return work

    return add_columns(docs, "n_shingles bigint, digest binary, sketch binary", task, text_col)


def _key_rows(docs: DataFrame, percent: int) -> DataFrame:
    """``(key, doc, need)`` for every kept block of every ``(doc, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_size(batches, "text", BYTES_AT_ONCE, ROWS_AT_ONCE):
            keys, ids, needs = [], [], []
            docs_of = batch.column("doc").to_pylist()
            for doc, tokens in zip(docs_of, shingle_sets(batch.column("text"))):
                for band, of_band in block_keys(tokens, percent):
                    keys.append(of_band)
                    ids.append(np.full(len(of_band), doc))
                    needs.append(np.full(len(of_band), shared_blocks(band), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(ids).astype(np.int64)),
                        pa.array(np.concatenate(needs)),
                    ],
                    names=["key", "doc", "need"],
                )

    return pass_through(docs, run, "key bigint, doc bigint, need int")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # Texts are in many pairs; each is taken apart once.
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")])
            which = both.fill_null("").dictionary_encode()
            sets = list(shingle_sets(which.dictionary))
            sides = which.indices.to_numpy().reshape(2, -1).tolist()
            keep = []
            for one, other in zip(*([sets[i] for i in side] for side in sides)):
                shared = len(np.intersect1d(one, other, assume_unique=True))
                union = len(one) + len(other) - shared
                keep.append(shared > 0 and 100 * shared >= percent * union)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    ids = pairs
    for side in ("a", "b"):
        texts = docs.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}"))
        needed = ids.select(side).distinct()
        if is_small(needed, NEEDED_ROWS):
            texts = texts.join(F.broadcast(needed), side, "left_semi")
        pairs = pairs.join(texts, side)
    return pass_through(pairs, run, "a bigint, b bigint").distinct()


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and sketches let them be similar."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, GROUPED_ROWS):
            if not batch.num_rows:
                continue
            size = np.stack([batch.column(f"n_shingles_{c}").to_numpy() for c in ("a", "b")])
            both = pa.chunked_array([batch.column("sketch_a"), batch.column("sketch_b")])
            row, swapped = np.arange(batch.num_rows), size[0] > size[1]
            known = _Sketches(both, np.arange(2 * len(row)))
            apart = known.differing(row + len(row) * swapped, row + len(row) * ~swapped)
            near = apart <= size.sum(axis=0) * (100 - percent) // (100 + percent)
            near &= size.max(axis=0) <= size.min(axis=0) * 100 // percent
            yield batch.filter(pa.array(near)).select(["a", "b"])

    for side in ("a", "b"):
        of_side = [F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", "sketch")]
        pairs = pairs.join(sketches.select(F.col("doc").alias(side), *of_side), side)
    return pass_through(pairs, run, "a bigint, b bigint")


def _star_pairs(members: DataFrame) -> DataFrame:
    """Every set with the smallest set of its groups that it meets most often."""
    least = members.groupBy("key").agg(F.min("doc").alias("b"))
    met = (
        members.join(least, "key")
        .filter(F.col("doc") != F.col("b"))
        .groupBy("doc", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("top")
    return met.groupBy("doc").agg(top).select(F.col("doc").alias("a"), (-F.col("top.b")).alias("b"))


def _open_pairs(members: DataFrame, sketches: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of a group that are not connected yet and whose sketches are close.

    ``members(key, doc, component)``.  A group goes to one task per pair of
    tiles, so that none has more than two tiles of it at once.  Unless it is to be
    ``every`` pair, a crowded group gives the nearest ones of each member and its ``key``.
    """
    groups = (
        members.groupBy("key")
        .agg(
            F.min("component").alias("_least"),
            F.max("component").alias("_most"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter("_least <> _most")
        .select("key", F.ceil(F.col("_n") / TILE).cast("int").alias("tiles"))
    )
    tile = F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    placed = (
        members.join(groups, "key")
        .join(sketches, "doc")
        .withColumn("tile", tile)
        .withColumn("other", F.explode(others))
        .select(
            "key",
            F.least("tile", "other").alias("low"),
            F.greatest("tile", "other").alias("high"),
            "tile",
            "doc",
            "component",
            "n_shingles",
            "sketch",
        )
    )
    ordered = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return pass_through(ordered, _compare(percent, every), "a bigint, b bigint, key bigint").distinct()


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some thousand rows at a time, with the number of each row's group."""
    parts: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for start in range(0, batch.num_rows, GROUPED_ROWS):
            parts.append(batch.slice(start, GROUPED_ROWS))
            n += parts[-1].num_rows
            if n >= GROUPED_ROWS:
                rows = pa.Table.from_batches(parts)
                group = _numbered(rows)
                done = int(np.searchsorted(group, group[-1]))
                if done:
                    yield rows.slice(0, done), group[:done]
                parts = rows.slice(done).to_batches()
                # A longer group is looked at again after as many rows more.
                n = n - done if done else 0
    if parts:
        rows = pa.Table.from_batches(parts)
        yield rows, _numbered(rows)


def _numbered(rows: pa.Table) -> np.ndarray:
    changed = np.zeros(rows.num_rows, dtype=bool)
    for name in ("key", "low", "high"):
        column = rows.column(name).to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.cumsum(changed)


class _Sketches:
    """Bit sketches of some rows, folded to each width that is asked for."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        data, ends = flat_bytes(column.combine_chunks())
        self._data = np.frombuffer(data.tobytes(), dtype=np.uint64)
        self._starts = ends[:-1][order] // 8
        self.words = np.diff(ends)[order] // 8
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of_width(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of that width at least, and where each row is among them."""
        if width not in self._folded:
            place = np.cumsum(self.words >= width) - 1
            matrix = np.empty((int(place[-1]) + 1, width), dtype=np.uint64)
            for words in np.unique(self.words[self.words >= width]).tolist():
                rows = np.flatnonzero(self.words == words)
                raw = self._data[self._starts[rows][:, None] + np.arange(words)]
                matrix[place[rows]] = folded(raw, width)
            self._folded[width] = matrix, place
        return self._folded[width]

    def differing(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Bits in which rows differ from others that are not narrower."""
        out = np.empty(len(one), dtype=np.int64)
        width = self.words[one]
        for words in np.unique(width).tolist():
            at = np.flatnonzero(width == words)
            matrix, place = self._of_width(words)
            far = matrix[place[one[at]]] ^ matrix[place[other[at]]]
            out[at] = np.bitwise_count(far).sum(axis=1)
        return out


def _compare(percent: int, every: bool) -> Callable:
    def pairs(rows: pa.Table, group: np.ndarray) -> Iterator[tuple]:
        """Members of all groups side by side: each with the next one, the one after that, ..."""
        size, doc = rows.column("n_shingles").to_numpy(), rows.column("doc").to_numpy()
        order = np.lexsort((doc, size, group))
        size, doc, group = size[order], doc[order], group[order]
        key, low, high, tile, component = (
            rows.column(c).to_numpy()[order] for c in ("key", "low", "high", "tile", "component")
        )
        crossing, sketches = low != high, _Sketches(rows.column("sketch"), order)
        widest = int(size.max()) * 100 // percent + 1
        ends = np.searchsorted(group * widest + size, group * widest + size * 100 // percent, side="right")
        members = np.bincount(group)
        found, crowded = np.zeros(len(members), dtype=np.int64), np.zeros(len(members), dtype=bool)
        spare = np.full((2, len(doc)), -1, dtype=np.int64)  # of the nearest member before and after
        nearest = np.zeros((2, len(doc)), dtype=np.int64)
        few: list[np.ndarray] = []
        left, step = np.arange(len(doc)), 0
        while True:
            step += 1
            left = left[left + step < ends[left]]
            if not len(left):
                break
            one, other = left, left + step
            open_ = component[one] != component[other]
            open_ &= ~crossing[one] | (tile[one] != tile[other])
            one, other = one[open_], other[open_]
            limit = (size[one] + size[other]) * (100 - percent) // (100 + percent)
            room = limit - sketches.differing(one, other)
            near = room >= 0
            one, other, room = one[near], other[near], room[near]
            if every:
                if len(one):
                    yield doc[one], doc[other], None
                continue
            found += np.bincount(group[one], minlength=len(found))
            crowded = found > members
            few.append(np.stack((one, other))[:, ~crowded[group[one]]])
            for side, (mine, its) in enumerate(((other, one), (one, other))):
                better = room > spare[side, mine]
                spare[side, mine[better]] = room[better]
                nearest[side, mine[better]] = its[better]
        if every:
            return
        kept = np.concatenate([np.zeros((2, 0), dtype=np.int64), *few], axis=1)
        kept = kept[:, ~crowded[group[kept[0]]]]
        which = (spare >= 0) & crowded[group]
        mine = np.concatenate([np.flatnonzero(w) for w in which])
        its = nearest[which]
        one, other = np.concatenate((kept[0], mine)), np.concatenate((kept[1], its))
        yield doc[one], doc[other], None
        yield doc[:0], doc[:0], key[np.searchsorted(group, np.flatnonzero(crowded))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pair is found in each group that both are in; most of that ends here.
        seen: set[tuple[int, int]] = set()
        for rows, group in _whole_groups(batches):
            for one, other, keys in pairs(rows, group):
                found = set(zip(np.maximum(one, other).tolist(), np.minimum(one, other).tolist()))
                found -= seen
                if len(seen) + len(found) > MAX_SEEN:
                    seen.clear()
                seen |= found
                crowded = [] if keys is None else keys.tolist()
                none = [None] * len(crowded)
                columns = [
                    [a for a, _ in found] + none,
                    [b for _, b in found] + none,
                    [None] * len(found) + crowded,
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["a", "b", "key"]
                )

    return run


def placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component that the links give each."""
    of_node = components(links).withColumnRenamed("node", "doc")
    return members.join(of_node, "doc", "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component")
    )


def link(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Add nothing to ``docs`` but return ``id_col, n_shingles, component_id``.

    Two documents are linked when ``100 * shared >= percent * union`` of their
    shingle sets; a component is named by its smallest id.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    sets = written(describe_sets(texts, "text").drop("text"), "sets")
    named = sets.filter("n_shingles > 0 and doc is not null")
    stands = named.groupBy("digest").agg(F.min("doc").alias("stand"))
    known = written(
        named.join(stands, "digest").select("doc", "stand", "n_shingles", "sketch", "digest"), "stands"
    )
    alone = known.filter("doc = stand").dropDuplicates(["doc", "digest"])

    shared = written(shared_rows(_key_rows(texts.filter("doc is not null"), percent)), "shared-blocks")
    often = shared.groupBy("doc", "need").agg(F.collect_list("key").alias("keys"))
    members = written(
        often.filter(F.size("keys") >= F.col("need"))
        .join(alone.select("doc").distinct(), "doc")
        .select(F.explode("keys").alias("key"), "doc")
        .distinct(),
        "members",
    )
    sketches = alone.select("doc", "n_shingles", "sketch")
    near = written(_close(_star_pairs(members), sketches, percent), "star-pairs")
    links = written(_verified(near, texts, percent), "star-links")
    near = written(_open_pairs(placed(members, links), sketches, percent, False), "open-pairs")
    tried = near.filter("key is null").select("a", "b")
    links = links.unionByName(written(_verified(tried, texts, percent), "open-links"))
    crowded = near.filter("key is not null").select("key").distinct()
    if not crowded.isEmpty():
        rest = placed(members.join(crowded, "key", "left_semi"), links)
        left = _open_pairs(rest, sketches, percent, True).join(tried, ["a", "b"], "left_anti")
        left = written(left.select("a", "b"), "open-pairs")
        if not left.isEmpty():
            links = links.unionByName(written(_verified(left, texts, percent), "open-links"))
    final = components(links)
    of_set = (
        stands.join(final.withColumnRenamed("node", "stand"), "stand", "left")
        .select("digest", F.coalesce("component", "stand").alias("_component"))
    )
    return (
        sets.join(of_set, "digest", "left")
        .withColumn(
            "component_id",
            F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("_component")).otherwise(
                F.col("doc")
            ),
        )
        .select(F.col("doc").alias(id_col), "n_shingles", "component_id")
    )
