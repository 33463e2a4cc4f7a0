"""Token ids in grammar-compressed shards (Re-Pair).

Texts are encoded with a byte-level merge vocabulary, each ends with an end id,
and the ids of consecutive documents form shards of about ``SHARD_IDS`` ids; a
document is never divided, so a longer one is a shard of its own.  In a shard, pairs
of neighbouring ids are counted exactly, frequent ones are replaced by nonterminals,
and so on until no pair occurs ``LEAST_COUNT`` times.  The shard stores the rules,
how many ids each nonterminal stands for, and the sequence that is left, so that any
range of ids is decoded from the symbols that cover it (:func:`read_range`).  A
pair never goes on over an end of a document.

A shard is one row of a table, and the table is the file: its Parquet files
hold ``part, shard, doc_ids, lengths, rules, sizes, sequence``, by ascending part and
shard.  Documents follow each other by ascending id; NULL texts are empty, and an
empty text is its end id alone.  Rows that occur twice are two documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BYTES_AT_ONCE, flat_bytes, pass_through, slices_by_size, written
from millrace.session import is_small

END_ID = 0
SHARD_IDS = 1 << 20
# Pairs that occur so often are replaced.
LEAST_COUNT = 8
# Places of the table that finds the rank of a pair.
_SLOT_BITS = 18
# Segments that an encoder remembers, and bytes of them.
MAX_CACHED = 1_500_000
MAX_CACHED_BYTES = 1 << 26
# Segments that go to the library in one text.
JOINED = 64
# Texts that go to the library at once.
ENCODED = 64
# Bytes of text whose segments are numbered at once.
NUMBERED_BYTES = 1 << 23

# Stands for an id of NULL.
NO_ID = -(2**63)

_SHARD = (
    "part int, shard int, first_id bigint, n_ids bigint, doc_ids binary, lengths binary, "
    "rules binary, sizes binary, sequence binary"
)
# Kinds of bytes.  From _GRAPHIC on they are not white space; signs are those that never share a
# token with a letter, as an apostrophe may.
_UNKNOWN, _BLANK, _LINE, _GRAPHIC, _SIGN, _LETTER = 0, 1, 2, 8, 16, 17
_KIND_OF = np.full(256, _UNKNOWN, dtype=np.uint8)
_KIND_OF[0x20], _KIND_OF[0x0A] = _BLANK, _LINE
# Of characters beyond ASCII, white space begins with C2, E1, E2 or E3.
_KIND_OF[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = _GRAPHIC
_KIND_OF[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^{|}~")] = _SIGN
_KIND_OF[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER


@dataclass(frozen=True)
class Grammar:
    """``rules[i]`` are the two symbols of nonterminal ``base + i``, ``sizes[i]`` its ids.

    A rule uses ids and earlier rules only.
    """

    base: int
    rules: np.ndarray
    sizes: np.ndarray
    sequence: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(symbols), dtype=np.int64)
        of_rules = symbols >= self.base
        out[of_rules] = self.sizes[symbols[of_rules] - np.uint32(self.base)]
        return out

    def _unfold(self, symbols: np.ndarray) -> np.ndarray:
        """Replace nonterminals until none is left."""
        while True:
            chosen = symbols >= self.base
            if not chosen.any():
                return symbols
            at = np.arange(len(symbols)) + np.cumsum(chosen) - chosen
            out = np.empty(len(symbols) + int(chosen.sum()), dtype=symbols.dtype)
            out[at] = symbols
            pairs = self.rules[symbols[chosen] - np.uint32(self.base)]
            out[at[chosen]], out[at[chosen] + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as ids."""
        if not len(symbols):
            return symbols
        # Each symbol that occurs is written out once and then copied; together they are
        # no longer than the result.
        occurs = np.zeros(int(symbols.max()) + 1, dtype=bool)
        occurs[symbols] = True
        which = np.flatnonzero(occurs).astype(symbols.dtype)
        place = (np.cumsum(occurs) - 1)[symbols]
        whole, sizes = self._unfold(which), self.lengths(which)
        begins = np.cumsum(sizes) - sizes
        each = sizes[place]
        ends = np.cumsum(each)
        return whole[np.repeat(begins[place] - ends + each, each) + np.arange(ends[-1])]

    def decode(self, start: int, end: int) -> np.ndarray:
        """The ids ``[start, end)``, from the symbols that cover them."""
        if start >= end:
            return self.sequence[:0]
        ends = np.cumsum(self.lengths(self.sequence))
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, end, side="left")) + 1
        skipped = int(ends[first - 1]) if first else 0
        return self.expand(self.sequence[first:last])[start - skipped : end - skipped]


def _frequent(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur ``LEAST_COUNT`` times, ascending, and their counts."""
    ordered = np.sort(pairs)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(at, len(ordered)))
    often = counts >= LEAST_COUNT
    return ordered[at[often]], counts[often]


def _slot(pairs: np.ndarray) -> np.ndarray:
    mixed = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed >>= np.uint64(64 - _SLOT_BITS)
    return mixed.view(np.int64)


def _ranks(pairs: np.ndarray, chosen: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank of each pair; ``len(chosen)`` where it is not among ``chosen``, which ascend."""
    none = len(chosen)
    slots = _slot(chosen)
    table = np.full(1 << _SLOT_BITS, none, dtype=np.int32)
    table[slots] = np.arange(none)
    table[slots[table[slots] != np.arange(none)]] = none + 1
    found = table[_slot(pairs)]
    # Where several chosen pairs have one place, they are told apart by search.
    search = np.flatnonzero(found > none)
    found[search] = np.minimum(np.searchsorted(chosen, pairs[search]), none - 1)
    equal = np.append(chosen, -1)[found] == pairs
    return np.where(equal, np.append(rank, none).astype(np.int32)[found], np.int32(none))


def compress(ids: np.ndarray, base: int, end_id: int = END_ID) -> Grammar:
    """Replace frequent pairs, round by round, until none is left.

    A round takes the frequent pairs by their counts.  Where two of them
    overlap, the more frequent one goes first; of a run of equal ids, every other pair.
    The most frequent pair is replaced in at least half of its places, so rounds end.

    Replacing makes new pairs with new symbols only, and makes the others rarer.  After the
    first round it is enough to count pairs with a symbol of the last round, and those
    that were frequent before.
    """
    n = len(ids)
    sequence = ids.astype(np.uint32)
    rules, sizes = [np.zeros((0, 2), dtype=np.uint32)], np.zeros(0, dtype=np.int64)
    closes = sequence == end_id  # symbols at whose end a document ends
    # Symbols keep their places, so that a round's work follows the pairs it counts: the places
    # that are left, and those next to each of them.
    left, counted = np.ones(n, dtype=bool), np.zeros(n + 1, dtype=bool)
    following, previous = np.arange(1, n + 1), np.arange(-1, n)
    at = np.flatnonzero(~closes[:-1])
    n_rules = 0
    while True:
        then = following[at]
        pairs = sequence[at].astype(np.int64)
        pairs <<= 32
        pairs |= sequence[then]
        chosen, counts = _frequent(pairs) if len(at) else (pairs, pairs)
        none = len(chosen)
        if not none:
            break
        rank = np.empty(none, dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(none)
        ranks = _ranks(pairs, chosen, rank)
        often = np.flatnonzero(ranks < none)
        at, then, ranks = at[often], then[often], ranks[often]
        # Where two places share a symbol, and of them the earlier one goes first.
        touch = then[:-1] == at[1:]
        ahead = touch & (ranks[:-1] <= ranks[1:])
        yields = touch & ~ahead
        goes = np.ones(len(at), dtype=bool)
        goes[1:] = ~ahead
        goes[:-1] &= ~yields
        # In a run of one rank, those after the first one by turns.
        run = np.flatnonzero(ahead & (ranks[:-1] == ranks[1:])) + 1
        begins = np.diff(run, prepend=-1) != 1
        turn = np.arange(len(run)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        goes[run] = (turn % 2 == 1) & ~np.append(yields, False)[run]
        worth = np.bincount(ranks[goes], minlength=none) >= LEAST_COUNT // 2
        goes = np.flatnonzero(goes & worth[ranks])
        by_rank = np.empty(none, dtype=np.int64)
        by_rank[rank] = chosen
        new = by_rank[worth]
        parts = np.column_stack((new >> 32, new & 0xFFFFFFFF))
        lengths = np.where(parts < base, 1, np.append(sizes, 1)[np.maximum(parts, base) - base])
        rules.append(parts.astype(np.uint32))
        sizes = np.concatenate((sizes, lengths.sum(axis=1)))
        number = np.cumsum(worth) - 1 + n_rules
        n_rules += len(new)
        places, gone = at[goes], then[goes]
        sequence[places] = base + number[ranks[goes]]
        closes[places] = closes[gone]
        left[gone] = False
        following[places] = following[gone]
        previous[following[gone]] = places
        # A pair that has lost a symbol to a replacement has a new one in its place.
        counted[at] = True
        counted[gone] = False
        counted[previous[places]] = True  # -1 is the place behind the last
        at = np.flatnonzero(counted[:-1])
        counted[at] = counted[-1] = False
        at = at[np.flatnonzero(~closes[at] & (following[at] < n))]
    return Grammar(base, np.concatenate(rules), sizes, sequence[left])


def _kinds(data: np.ndarray) -> np.ndarray:
    """What each byte of UTF-8 texts is.

    The first byte of a character that may be white space, and the later bytes of all but the
    Latin letters, are ``_UNKNOWN``.
    """
    kinds = np.frombuffer(bytearray(data.tobytes().translate(_KIND_OF.tobytes())), dtype=np.uint8)
    latin = np.flatnonzero(data - np.uint8(0xC3) <= 0xC8 - 0xC3)
    kinds[latin] = kinds[latin + 1] = _LETTER
    # Signs for times and divided by stand between the letters.
    signs = latin[(data[latin] == 0xC3) & ((data[latin + 1] & 0xDF) == 0x97)]
    kinds[signs] = kinds[signs + 1] = _GRAPHIC
    return kinds


def _segments(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where texts fall into segments whose tokens do not depend on each other.

    A token begins at a blank before something that is not white space, where letters and signs
    meet, and on both sides of a line feed that is the only white space there.
    """
    kinds = _kinds(data)
    filled = np.flatnonzero(np.diff(ends))
    graphic = kinds >= _GRAPHIC
    before = np.append(graphic[1:], False)
    before[ends[filled + 1] - 1] = False
    line = (kinds == _LINE) & before
    line[1:] &= graphic[:-1]
    begins = ((kinds == _BLANK) & before) | line
    begins[1:] |= line[:-1]
    # Of the kinds, only a sign and a letter differ in one bit and are that high.
    begins[1:] |= (kinds[1:] ^ kinds[:-1] == _SIGN ^ _LETTER) & (kinds[1:] >= _SIGN)
    begins[ends[filled]] = True
    return begins


class Encoder:
    """The tokenizers library, segment by segment with a memory.

    Texts are cut where a token always begins (:func:`_segments`), and the library encodes each
    different segment once, by itself or with many others in one text.
    Texts with the name of a special token are one segment.  With ``end_id``, each text ends with it.
    """

    def __init__(self, tokenizer_file: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self.base = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # Tokens are written in an alphabet of one letter per byte.
        self._sizes = np.zeros(self.base, dtype=np.int64)
        for token, token_id in self._tokenizer.get_vocab().items():
            self._sizes[token_id] = len(token)
        self._end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        self._forget()

    def _forget(self) -> None:
        # Known segments and the bytes of their ids; the empty one stands at the end of a text.
        self._known = pa.array([b""], pa.large_binary())
        self._coded = pa.array([self._end], pa.large_binary())

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        # What the library returns takes many times the room of its ids.
        for start in range(0, len(texts), ENCODED):
            part = texts[start : start + ENCODED]
            found = self._tokenizer.encode_batch_fast(part, add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4") for e in found]
        return out

    def _learn(self, segments: pa.Array) -> None:
        data, ends = flat_bytes(segments)
        kinds = _kinds(data)
        first, last = ends[:-1], ends[1:] - 1
        closed = kinds[last] >= _GRAPHIC
        second = kinds[np.minimum(first + 1, last)] >= _GRAPHIC
        blank = np.flatnonzero(closed & second & (kinds[first] == _BLANK))
        bare = np.flatnonzero(closed & (kinds[first] >= _GRAPHIC))
        alone = np.ones(len(segments), dtype=bool)
        order, coded = [], []
        for which, mark in ((blank, b""), (bare, b"\n")):
            found = self._joined(segments.take(pa.array(which)), mark)
            if found is not None:
                order.append(which)
                coded.append(found)
                alone[which] = False
        order.append(np.flatnonzero(alone))
        texts = segments.take(pa.array(order[-1])).cast(pa.large_string()).to_pylist()
        coded.append(pa.array([x.tobytes() for x in self._encoded(texts)], pa.large_binary()))
        new = pa.concat_arrays(coded).take(pa.array(np.argsort(np.concatenate(order))))
        self._coded = pa.concat_arrays([self._coded, new])

    def _joined(self, segments: pa.Array, mark: bytes) -> pa.Array | None:
        """Ids of segments, many in one text with ``mark`` behind each."""
        if mark:
            behind = [pa.scalar(x, segments.type) for x in (mark, b"")]
            segments = pc.binary_join_element_wise(segments, *behind)
        data, ends = flat_bytes(segments)
        whole, cuts = data.tobytes(), [*ends[:-1:JOINED].tolist(), len(data)]
        texts = [whole[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        if any(special in text for special in self._special for text in texts):
            return None
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *self._encoded(texts)])
        # Segments and marks are told apart by their bytes.
        ends = np.append(np.column_stack((ends[:-1], ends[1:] - len(mark))), len(data))
        cuts = 4 * np.searchsorted(np.cumsum(self._sizes[ids]), ends, side="right")
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(ids)]
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, buffers)
        return both.take(pa.array(np.arange(0, len(both), 2)))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts behind each other, and where those of each text end."""
        data, ends = flat_bytes(texts)
        begins = _segments(data, ends) if len(data) else np.zeros(0, dtype=bool)
        for special in self._special:
            for i in np.flatnonzero(pc.match_substring(texts, special).fill_null(False)).tolist():
                begins[ends[i] + 1 : ends[i + 1]] = False
        begins = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers)
        return segments, np.searchsorted(begins, ends[1:])

    def ids(self, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each column, the ids of its texts behind each other and how many each text has."""
        if len(self._known) > MAX_CACHED or self._known.nbytes > MAX_CACHED_BYTES:
            self._forget()
        cut = [self._cut(texts) for texts in columns]
        # Known segments keep their numbers, new ones come behind them.
        start, arrays = len(self._known), [self._known, *(segments for segments, _ in cut)]
        numbered = pa.chunked_array(arrays).dictionary_encode().chunks
        self._known = numbered[0].dictionary
        self._learn(self._known.slice(start))
        numbers = np.concatenate([x.indices for x in numbered])
        for segments, ends in cut:
            segment = np.insert(numbers[start : start + len(segments)], ends, 0)
            start += len(segments)
            data, begins = flat_bytes(self._coded.take(pa.array(segment)))
            begins = begins[np.append(0, ends + np.arange(1, len(ends) + 1))]
            yield data.view("<u4"), np.diff(begins) // 4

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, lengths = next(self.ids([pa.array(texts, pa.large_string())]))
        ends = np.cumsum(lengths)
        return [ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist())]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(tokenizer_file: str, end_id: int) -> Encoder:
    """One per Python worker."""
    key = (tokenizer_file, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def shards(
    docs: DataFrame,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode and compress; one row per shard, documents by ascending id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(tokenizer_file, end_id), TaskContext.get().partitionId(), 0
        # Doc ids, lengths and ids of the documents of the open shard.
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for group in _groups(batches):
            found = list(encode.ids([batch.column("text") for batch in group]))
            numbers = [batch.column("id").fill_null(NO_ID).to_numpy() for batch in group]
            del group
            while found:
                (ids, lengths), doc_ids = found.pop(0), numbers.pop(0)
                ends, first, start = np.cumsum(lengths), 0, 0
                while first < len(ends):
                    last = int(np.searchsorted(ends, start + shard_ids - size)) + 1
                    end = int(ends[min(last, len(ends)) - 1])
                    held.append((doc_ids[first:last], lengths[first:last], ids[start:end]))
                    size += end - start
                    first, start = last, end
                    if size >= shard_ids:
                        yield _shard_row(part, shard, held, encode.base, end_id)
                        held, size, shard = [], 0, shard + 1
        if held:
            yield _shard_row(part, shard, held, encode.base, end_id)

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
    )
    return pass_through(ordered, run, _SHARD)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of bounded text, together about ``NUMBERED_BYTES``."""
    group, size = [], 0
    for batch in slices_by_size(batches, "text", BYTES_AT_ONCE):
        group.append(batch)
        size += batch.column("text").nbytes
        if size >= NUMBERED_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _shard_row(
    part: int, shard: int, held: list[tuple[np.ndarray, ...]], base: int, end_id: int
) -> pa.RecordBatch:
    base = max(base, end_id + 1)
    doc_ids, lengths, ids = map(np.concatenate, zip(*held))
    grammar = compress(ids, base, end_id)
    values = [
        [part],
        [shard],
        [int(doc_ids[0])],
        [len(ids)],
        [doc_ids.astype("<i8").tobytes()],
        [lengths.astype("<i8").tobytes()],
        [np.concatenate((grammar.rules, np.full((1, 2), base, np.uint32))).astype("<u4").tobytes()],
        [grammar.sizes.astype("<i8").tobytes()],
        [grammar.sequence.astype("<u4").tobytes()],
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = ["part", "shard", "first_id", "n_ids", "doc_ids", "lengths", "rules", "sizes", "sequence"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)


def grammar_of(rules: bytes, sizes: bytes, sequence: bytes) -> Grammar:
    """The grammar of a stored shard; its last rule names the first nonterminal."""
    table = np.frombuffer(rules, dtype="<u4").reshape(-1, 2)
    return Grammar(
        int(table[-1, 0]),
        table[:-1],
        np.frombuffer(sizes, dtype="<i8"),
        np.frombuffer(sequence, dtype="<u4"),
    )


def with_starts(stored: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all shards before each shard.

    Totals of parts are few and run up on one task; shards run up within
    their part.
    """
    starts = _starts(stored)
    # A row of two numbers per shard; the shards themselves should not move.
    return stored.join(F.broadcast(starts) if is_small(starts) else starts, ["part", "shard"])


def _starts(stored: DataFrame) -> DataFrame:
    """``part, shard, n_ids, start`` of every shard; the grammars are not read."""
    parts = stored.groupBy("part").agg(F.min("first_id").alias("first"), F.sum("n_ids").alias("n"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part"))
    return (
        stored.select("part", "shard", "n_ids")
        .withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(part_start, "part")
        .select("part", "shard", (F.col("_part") + F.col("_inside")).alias("start"))
    )


def read_range(stored: DataFrame, start: int, end: int) -> DataFrame:
    """The ids ``[start, end)`` of the whole table: ``start, n_ids, ids`` by shard.

    ``start`` counts from the beginning of the table, ``ids`` are little-endian
    32-bit integers.  Parts and shards ascend with positions, so those of the range lie
    between two of them, which the scan is told: files outside are not opened.  Of a
    shard, only the symbols that cover the range are expanded.  A range that is empty
    or beyond the table gives no rows; one that begins or ends there is cut to it.
    """
    spark, ddl = stored.sparkSession, "start bigint, n_ids bigint, ids binary"
    starts = stored.select("part", "shard", "n_ids").join(_starts(stored), ["part", "shard"])
    hit = starts.filter((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start))
    place = F.struct("part", "shard")
    first, last = hit.agg(F.min(place), F.max(place)).first()
    if start >= end or first is None:
        return spark.createDataFrame([], ddl)
    part, shard = F.col("part"), F.col("shard")
    between = (
        part.between(first["part"], last["part"])
        & ((part > first["part"]) | (shard >= first["shard"]))
        & ((part < last["part"]) | (shard <= last["shard"]))
    )
    shards_of = stored.filter(between).select("part", "shard", "n_ids", "rules", "sizes", "sequence")
    places = hit.select("part", "shard", "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = grammar_of(row["rules"], row["sizes"], row["sequence"])
                low, high = max(start, row["start"]), min(end, row["start"] + row["n_ids"])
                ids = grammar.decode(low - row["start"], high - row["start"])
                values = ([low], [high - low], [ids.astype("<u4").tobytes()])
                kinds = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds)], names=["start", "n_ids", "ids"]
                )

    chosen = shards_of.join(F.broadcast(places) if is_small(places) else places, ["part", "shard"])
    return chosen.mapInArrow(run, ddl)


def read_documents(stored: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, in its stored order.

    ``ids`` are little-endian 32-bit integers; with ``digest`` there is
    ``ids_crc32`` in their place.
    """
    last = ("ids_crc32", pa.int64(), "bigint") if digest else ("ids", pa.binary(), "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = grammar_of(row["rules"], row["sizes"], row["sequence"])
                data = memoryview(grammar.expand(grammar.sequence).astype("<u4")).cast("B")
                lengths = np.frombuffer(row["lengths"], dtype="<i8")
                ends = np.cumsum(lengths)
                doc_ids = np.frombuffer(row["doc_ids"], dtype="<i8")
                for first in range(0, len(ends), 1024):
                    yield documents(row["start"], data, doc_ids, ends, lengths, slice(first, first + 1024))

    def documents(start, data, doc_ids, ends, lengths, part: slice) -> pa.RecordBatch:
        begins = ends[part] - lengths[part]
        ids = [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends[part].tolist())]
        values = [zlib.crc32(x) if digest else bytes(x) for x in ids]
        columns = [
            pa.array(doc_ids[part], mask=doc_ids[part] == NO_ID),
            pa.array(start + begins),
            pa.array(lengths[part]),
            pa.array(values, last[1]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", last[0]])

    ddl = f"doc_id bigint, start bigint, n_tokens bigint, {last[0]} {last[2]}"
    return pass_through(with_starts(stored), run, ddl)


def write(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and open them."""
    return written(shards(docs, tokenizer_file, **options), "token-shards")

