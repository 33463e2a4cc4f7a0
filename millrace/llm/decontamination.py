"""Benchmark passages in documents, by one Aho-Corasick automaton.

Both sides are normalised alike: ASCII letters in lower case, words of ASCII
letters, ASCII digits and any other character beyond ASCII, one space between
words.  Every run of ``window`` item words (all words of a shorter item) is a
pattern of one automaton, which reads a text once and finds all of them.

NULL and empty texts have no words and match nothing.  Rows and items that
occur twice are treated as they come; an item id counts once per document.
Items without an id are matched like others and count as one item together;
the list of items leaves them out.  Items without text hold no passage.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_columns, text_bytes, written

WINDOW = 10

# Benchmark text in one automaton; more of it is read in several passes.
MAX_AUTOMATON_BYTES = 8 * 1024 * 1024

_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]")
_NORMAL = bytes(
    b if _WORD_BYTES.match(bytes([b])) else 32 for b in bytes(range(256)).lower()
)
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_PASS = "n_words bigint, _ranges array<bigint>, _items array<string>"
_RESULT = (
    "n_hit bigint, n_items bigint, items array<string>, items_sha256 string, "
    "contaminated boolean, spans array<struct<begin: bigint, end: bigint>>"
)

_automata: dict[str, tuple] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def patterns(
    items: list[tuple[str | None, bytes]], window: int
) -> dict[str, tuple[int, set[str | None]]]:
    """Normalised windows with their number of words and the items that hold them."""
    found: dict[str, tuple[int, set[str | None]]] = {}
    for item, text in items:
        of_item = words(text)
        if not of_item:
            continue
        size = min(window, len(of_item))
        for i in range(len(of_item) - size + 1):
            key = _line(of_item[i : i + size])
            found.setdefault(key, (size, set()))[1].add(item)
    return found


def _in_order(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda item: (item is not None, item or ""))


def _line(of_text: list[bytes]) -> str:
    # One character per byte, so that offsets are byte offsets.
    return (b" " + b" ".join(of_text) + b" ").decode("latin-1")


def _automaton(key: str, items: list[tuple[str | None, bytes]], window: int):
    """Built once per Python worker."""
    if key not in _automata:
        found = patterns(items, window)
        automaton = ahocorasick.Automaton()
        for line, (size, ids) in found.items():
            automaton.add_word(line, (size, _in_order(ids)))
        if found:
            automaton.make_automaton()
        _automata.clear()
        _automata[key] = (automaton, bool(found))
    return _automata[key]


def scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str | None]]:
    """Words of the text, hit word ranges ``[begin, end)``, items found."""
    of_text = words(text)
    if automaton is None or not of_text:
        return len(of_text), [], set()
    line = _line(of_text)
    hits = list(automaton.iter(line))
    if not hits:
        return len(of_text), [], set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
    lasts = np.searchsorted(spaces, [end for end, _ in hits]).tolist()
    items: set[str | None] = set()
    ranges = []
    for last, (_, (size, ids)) in zip(lasts, hits):
        items.update(ids)
        ranges.append((last - size, last))
    return len(of_text), merged(ranges), items


def merged(ranges) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the text as it was."""
    if not ranges:
        return []
    places = [m.span() for m in _WORDS.finditer(text)]
    begins = np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80
    chars = np.concatenate(([0], np.cumsum(begins)))
    return [(int(chars[places[a][0]]), int(chars[places[b - 1][1]])) for a, b in ranges]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_automaton_bytes: int = MAX_AUTOMATON_BYTES,
) -> DataFrame:
    """Mark the words of each text that lie in a benchmark window.

    Adds ``n_words``, ``n_hit``, ``n_items``, ``items``, ``items_sha256``,
    ``contaminated`` and ``spans`` (character ranges of the original text).
    A benchmark whose text exceeds ``max_automaton_bytes`` is cut into parts of
    that size, and the texts are read once per part.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")
    ).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-int(size) // max_automaton_bytes))
    out = docs
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        out = _scan_part(out, chosen, window, text_col, first=part == 0)
        if part + 1 < parts:
            out = written(out, "decontamination")
    return _summary(out, text_col)


def _scan_part(
    docs: DataFrame, items: DataFrame, window: int, text_col: str, first: bool
) -> DataFrame:
    rows = [(row["item"], row["text"].encode()) for row in items.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    key = hashlib.sha256(repr((window, sorted(rows, key=repr))).encode()).hexdigest()

    def task():
        automaton, any_pattern = _automaton(key, shared.value, window)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            names = batch.schema.names
            counts, ranges, items = [], [], []
            for row, text in enumerate(text_bytes(batch.column(names.index(text_col)))):
                n, hit, found = scan(text, automaton if any_pattern else None)
                if not first:
                    flat = batch.column(names.index("_ranges"))[row].as_py()
                    hit = merged([*hit, *zip(flat[::2], flat[1::2])])
                    found |= set(batch.column(names.index("_items"))[row].as_py())
                counts.append(n)
                ranges.append([x for pair in hit for x in pair])
                items.append(_in_order(found))
            return [
                pa.array(counts, pa.int64()),
                pa.array(ranges, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())),
            ]

        return work

    return add_columns(docs, _PASS, task)


def _summary(scanned: DataFrame, text_col: str) -> DataFrame:
    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            names = batch.schema.names
            texts = text_bytes(batch.column(names.index(text_col)))
            flat = batch.column(names.index("_ranges")).to_pylist()
            found = batch.column(names.index("_items")).to_pylist()
            items = [[item for item in row if item is not None] for row in found]
            ranges = [list(zip(row[::2], row[1::2])) for row in flat]
            spans = [
                [{"begin": a, "end": b} for a, b in original_spans(text, hit)]
                for text, hit in zip(texts, ranges)
            ]
            digests = [hashlib.sha256(",".join(row).encode()).hexdigest() for row in items]
            hit = [sum(b - a for a, b in row) for row in ranges]
            return [
                pa.array(hit, pa.int64()),
                pa.array([len(row) for row in found], pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(digests, pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            ]

        return work

    return add_columns(scanned, _RESULT, task).drop("_ranges", "_items")
