"""Repeated stretches of text across documents, removed byte by byte.

A byte goes if it lies in ``span`` bytes that also start in a document with a
smaller id.  Which stretches are equal is read off the Burrows-Wheeler
transform and common prefixes of collections of short strings, built column by
column (:mod:`column_bwt`):

1. Texts are reduced to anchors.  Anchors that only one text has are left out;
   all windows that can repeat have an anchor that is left.
2. The bytes around an anchor that hold all its windows are one string.  A task
   keeps each string once, for the smallest document it met it in; in others it
   is repeated as a whole, which settles them.
3. Strings go by anchor to the collections, their anchors in one column.  There
   each start is marked whose next ``span`` symbols a smaller document has too.

An anchor with very many different strings is not sent as one group: its
windows become strings of their own and are spread by their bytes.

NULL texts are empty.  Rows without an id are kept whole, and nothing is removed
because of them.  Rows with equal ids do not count as smaller or larger than one
another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.anchors import GRAM, anchors
from millrace.llm.column_bwt import ABSENT, repeated
from millrace.llm.common import add_columns, flat_bytes, shared_rows, slices, text_bytes, written
from millrace.session import is_small

SPAN = 50
# Anchors of more texts than this are spread by their windows.
HOT = 50_000
# Strings that a task keeps before it hands them on.
MAX_KEPT = 1 << 18

_ROW = "key bigint, doc bigint, text_key bigint, left int, string binary, starts binary, spans binary"
_SPANS = "doc bigint, text_key bigint, spans binary"


def _anchor_rows(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """``(key, doc)``, once for every different anchor of a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), text_bytes(batch.column("text"))):
                found = np.unique(anchors(np.frombuffer(text, np.uint8), span, gram)[0])
                keys.append(found)
                docs.append(np.full(len(found), doc, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs))],
                names=["key", "doc"],
            )

    return texts.mapInArrow(run, "key bigint, doc bigint")


class _Kept:
    """Strings of a task, each for the smallest document it was met in."""

    def __init__(self):
        # Of each string: document, and per row of that id where it starts.
        self._of: dict[tuple, tuple[int, list]] = {}
        self._spans: dict[tuple[int, int], list] = {}

    def __len__(self) -> int:
        return len(self._of)

    def add(self, string: tuple, doc: int, text_key: int, start: int) -> None:
        found = self._of.get(string)
        if found is None or doc < found[0]:
            if found is not None:
                self._settle(string, *found)
            self._of[string] = (doc, [(text_key, start)])
        elif doc == found[0]:
            found[1].append((text_key, start))
        else:
            self._settle(string, doc, [(text_key, start)])

    def _settle(self, string: tuple, doc: int, places: list) -> None:
        for text_key, start in places:
            self._spans.setdefault((doc, text_key), []).append((start, start + len(string[2])))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Hand on strings and what was settled, and forget them."""
        rows: list[tuple] = []
        for (key, left, string), (doc, places) in self._of.items():
            by_row: dict[int, list[int]] = {}
            for text_key, start in places:
                by_row.setdefault(text_key, []).append(start)
            for text_key, starts in by_row.items():
                raw = np.array(starts, dtype="<i8").tobytes()
                rows.append((key, doc, text_key, left, string, raw, None))
        for (doc, text_key), spans in self._spans.items():
            rows.append((text_key, doc, text_key, None, None, None, _packed(spans)))
        self._of, self._spans = {}, {}
        kinds = [*[pa.int64()] * 3, pa.int32(), *[pa.binary()] * 3]
        names = ["key", "doc", "text_key", "left", "string", "starts", "spans"]
        for first in range(0, len(rows), 8192):
            columns = zip(*rows[first : first + 8192])
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _packed(spans: list[tuple[int, int]]) -> bytes:
    """Spans as one, overlapping and touching ones joined."""
    return joined(np.array(spans, dtype=np.int64).reshape(-1, 2)).astype("<i8").tobytes()


def joined(spans: np.ndarray) -> np.ndarray:
    """Sorted spans; overlapping and touching ones become one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    last = np.append(first[1:], len(spans)) - 1
    return np.column_stack((spans[first, 0], reach[last]))


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, begin, end)`` of the runs of true values in each row."""
    edges = np.zeros((len(marked), marked.shape[1] + 2), dtype=bool)
    edges[:, 1:-1] = marked
    changes = np.flatnonzero((edges[:, 1:] != edges[:, :-1]).ravel()).reshape(-1, 2)
    row, begin = np.divmod(changes[:, 0], marked.shape[1] + 1)
    return row, begin, changes[:, 1] - row * (marked.shape[1] + 1)


def _joined_rows(docs: np.ndarray, text_keys: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """A row per text with its spans, overlapping and touching ones joined."""
    order = np.lexsort((spans[:, 0], text_keys, docs))
    docs, text_keys, spans = docs[order], text_keys[order], spans[order]
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (text_keys[1:] != text_keys[:-1])))
    # Texts behind each other, too far apart to touch.
    shift = (np.cumsum(new) * (spans.max() + 2))[:, None]
    whole = joined(spans + shift)
    text = np.searchsorted(whole[:, 0], shift[new][:, 0])
    whole -= np.repeat(shift[new], np.diff(np.append(text, len(whole))), axis=0)
    offsets = (np.append(text, len(whole)) * 16).astype(np.int32)
    data = np.ascontiguousarray(whole.astype("<i8"))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    packed = pa.Array.from_buffers(pa.binary(), len(text), buffers)
    arrays = [pa.array(docs[new]), pa.array(text_keys[new]), packed]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "text_key", "spans"])


def _strings(candidates: DataFrame, span: int, gram: int) -> DataFrame:
    """Strings around the anchors ``keys`` of each text; windows of those in ``hot``."""
    column = span - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept()
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("doc", "text_key")]
            keys, hots = batch.column("keys"), batch.column("hot")
            for row, (doc, text_key, text) in enumerate(zip(*columns, text_bytes(batch.column("text")))):
                wanted = np.sort(keys[row].values.to_numpy().view(np.uint64))
                hot = np.isin(wanted, hots[row].values.to_numpy().view(np.uint64))
                key, place, first, last = anchors(np.frombuffer(text, np.uint8), span, gram)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                chosen = np.flatnonzero(wanted[at] == key)
                found = (
                    key[chosen].view(np.int64),
                    column - place[chosen] + first[chosen],
                    first[chosen],
                    last[chosen],
                    hot[at[chosen]],
                )
                for of, left, a, b, spread in zip(*(values.tolist() for values in found)):
                    if not spread:
                        kept.add((of, left, text[a : b + span]), doc, text_key, a)
                        continue
                    for start in range(a, b + 1):
                        window = text[start : start + span]
                        own = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                        kept.add((own, left + start - a, window), doc, text_key, start)
                if len(kept) > MAX_KEPT:
                    yield from kept.batches()
        yield from kept.batches()

    return candidates.mapInArrow(run, _ROW)


def _collections(strings: DataFrame, span: int, gram: int) -> DataFrame:
    """Spans of the strings that stand in a smaller document too.

    What tasks have settled passes through.
    """
    columns = span - gram + 1
    width = columns + span - 1

    def collection(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, ends = flat_bytes(batch.column("string"))
        left, sizes = batch.column("left").to_numpy(), np.diff(ends)
        symbols = np.full((batch.num_rows, width), ABSENT, dtype=np.uint16)
        shift = np.arange(batch.num_rows) * width + left - ends[:-1]
        symbols.ravel()[np.repeat(shift, sizes) + np.arange(len(flat))] = flat
        owners = batch.column("doc").to_numpy()
        found = repeated(symbols, owners, span, columns)
        # Runs of marked starts, each at all places of its string.
        row, begin, end = _runs(found)
        begin, end = begin - left[row], end - 1 + span - left[row]
        places, at = flat_bytes(batch.column("starts"))
        starts, first, n = places.view("<i8"), at[:-1] // 8, np.diff(at) // 8
        which = np.repeat(np.arange(len(row)), n[row])
        of_run = np.cumsum(n[row]) - n[row]
        start = starts[first[row[which]] + np.arange(len(which)) - of_run[which]]
        spans = np.column_stack((start + begin[which], start + end[which]))
        if len(spans):
            yield _joined_rows(owners[row[which]], batch.column("text_key").to_numpy()[row[which]], spans)

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Groups that are complete; single strings have nothing to repeat."""
        keys = batch.column("key").to_numpy()
        new = np.concatenate(([True], keys[1:] != keys[:-1], [True]))
        shared = np.flatnonzero(~(new[:-1] & new[1:]))
        if len(shared):
            yield from collection(batch.take(pa.array(shared)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        for batch in batches:
            settled = batch.filter(batch.column("spans").is_valid())
            if settled.num_rows:
                yield settled.select(["doc", "text_key", "spans"])
            held, batch = last, batch.filter(batch.column("string").is_valid())
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # The last group may go on in the next batch.
            keys = batch.column("key").to_numpy()
            start = int(np.searchsorted(keys, keys[-1]))
            last = batch.slice(start)
            if start:
                yield from whole(batch.slice(0, start))
        if last is not None:
            yield from whole(last)

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, _SPANS)


def repeated_spans(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(doc, text_key, spans)`` of the bytes to remove, in several rows per text.

    ``texts(doc, text_key, text)``; ``text_key`` tells rows of one id apart.
    """
    shared = written(shared_rows(_anchor_rows(texts, span, gram), HOT), "shared-anchors")
    hot = shared.filter("doc is null").select("key", F.lit(True).alias("hot"))
    wanted = (
        shared.filter("doc is not null")
        .join(F.broadcast(hot) if is_small(hot) else hot, "key", "left")
        .groupBy("doc")
        .agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))
    )
    return _collections(_strings(texts.join(wanted, "doc"), span, gram), span, gram)


def remove_repeats(
    docs: DataFrame,
    span: int = SPAN,
    id_col: str = "doc_id",
    text_col: str = "text",
    as_text: bool = False,
) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``removed`` and ``kept``.

    ``removed`` are spans of bytes, ``kept`` the other bytes, or with
    ``as_text`` a text, in which characters that lost a byte are missing.
    """
    keyed = docs.withColumns(
        {
            "_doc": F.col(id_col).cast("bigint"),
            "_key": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )
    texts = keyed.filter(F.octet_length(text_col) >= span).select(
        F.col("_doc").alias("doc"), F.col("_key").alias("text_key"), F.col(text_col).alias("text")
    )
    found = (
        written(repeated_spans(texts.filter("doc is not null"), span), "repeated-spans")
        .groupBy(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"))
        .agg(F.collect_list("spans").alias("_spans"))
    )
    return _removed(keyed.join(found, ["_doc", "_key"], "left"), text_col, as_text).drop(
        "_doc", "_key", "_spans"
    )


def _removed(docs: DataFrame, text_col: str, as_text: bool) -> DataFrame:
    kept_type = "string" if as_text else "binary"

    def cut(text: bytes, packed: list[bytes] | None) -> tuple[np.ndarray, bytes]:
        if not packed:
            return np.zeros((0, 2), dtype=np.int64), text
        spans = joined(np.frombuffer(b"".join(packed), dtype="<i8").reshape(-1, 2))
        edges = [0, *spans.ravel().tolist(), len(text)]
        return spans, b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])

    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            names = batch.schema.names
            texts = text_bytes(batch.column(names.index(text_col)))
            packed = batch.column(names.index("_spans")).to_pylist()
            cuts = [cut(text, row) for text, row in zip(texts, packed)]
            spans = [s for s, _ in cuts]
            kept = [k for _, k in cuts]
            return [
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()),
                pa.array(
                    [[{"begin": a, "end": b} for a, b in s.tolist()] for s in spans],
                    pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
                ),
                pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                if as_text
                else pa.array(kept, pa.binary()),
            ]

        return work

    ddl = (
        "n_bytes bigint, n_removed bigint, n_spans bigint, "
        f"removed array<struct<begin: bigint, end: bigint>>, kept {kept_type}"
    )
    return add_columns(docs, ddl, task)
