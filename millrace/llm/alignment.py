"""Alignment of two tokenizers over the same texts.

Every text is cut into tokens by a byte-level merge vocabulary (A) and by a
piece model (B).  Where a token of A and one of B end at the same byte, the two are
linked, and the links cut the text into groups: the fewest tokens of A and B
that stand for the same bytes.

Lockstep: a pair of pointers, one into the ends of A's tokens and one into
those of B's, runs along each document.  One NumPy vector holds the pointers of
all documents of a batch and moves all of them at once: equal ends give
a link and a cut and move both, else the pointer behind moves.  Finished
documents are taken out of the vector.  A long document takes part as several lanes that
begin at different bytes, as ends can be compared anywhere; so the number of steps is
bounded by ``LANE_TOKENS`` and not by the longest text.

Tokens come from the two libraries.  A blank after something that is not white
space always begins a token of either kind, so the stretches between such
blanks are encoded once and remembered, within ``MEMORY_BYTES``.  Texts in
which white space meets such a blank are encoded whole.

Texts that are NULL or empty, or of which either tokenizer does not give back
the bytes (the blank sign itself comes back as a blank), have no tokens and no links.
Names of special tokens are plain text.  Rows are aligned on their own, repeated
ones alike; a pair of ids is counted over all rows, and the highest counts of an id may be
several (ties all count as best).  Empty tables give no rows; very long texts need memory
in proportion to their own length.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_columns

LANE_TOKENS = 192
# Text that goes in lockstep at a time; tokens and pointers are a multiple of it.
BATCH_BYTES = 1 << 20
# Text and ids remembered by a worker, about.
MEMORY_BYTES = 40 << 20
# What a remembered word takes besides its letters.
WORD_BYTES = 190
# A pair of ids as one number.
B_BITS = 24

BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as
    they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the byte length of each of their tokens."""

    def __init__(self, merges_file: str, pieces_file: str):
        # Tasks are the threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        with open(merges_file, encoding="utf-8") as file:
            config = json.load(file)
        # Without them, names of special tokens are plain text.
        config["added_tokens"], config["post_processor"] = [], None
        self._a = Tokenizer.from_str(json.dumps(config))
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces_file)
        letters = byte_alphabet()
        vocabulary = self._a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            self.a_bytes[at] = bytes(letters[c] for c in token if c in letters)
        with open(pieces_file, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.b_bytes = []
        for piece in model.pieces:
            if piece.type == kind.BYTE:
                self.b_bytes.append(bytes([int(piece.piece[1:-1], 16)]))
            elif piece.type in (kind.CONTROL, kind.UNKNOWN):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.piece.replace(BLANK, " ").encode())
        spec = model.normalizer_spec
        inside = any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces)
        # Whether no token of B goes on over a blank after something else.
        self.by_words = spec.add_dummy_prefix and not (
            inside or spec.precompiled_charsmap or spec.remove_extra_whitespaces
        )
        self.a_size = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.reset()

    def reset(self) -> None:
        self._place: dict[str, int] = {}
        self._ids = (array("i"), array("i"))
        self._ends = (array("q", [0]), array("q", [0]))
        self._same = bytearray()
        self._uses = np.zeros(0, dtype=np.int64)
        self._held = 0

    def _forget(self) -> None:
        """Keep the words that came up again, most used first, within half the memory."""
        uses, words = self._uses, list(self._place)
        order = np.argsort(-uses, kind="stable")
        held = np.cumsum([len(word) + WORD_BYTES for word in words])[-1] / max(1, len(words))
        order = np.sort(order[: min(int((uses > 1).sum()), int(MEMORY_BYTES / 2 / held))])
        old = [np.frombuffer(ids, dtype=np.int32) for ids in self._ids]
        ends = [np.frombuffer(e, dtype=np.int64) for e in self._ends]
        same, kept = self._same, [words[i] for i in order.tolist()]
        self.reset()
        for side in (0, 1):
            n = (ends[side][1:] - ends[side][:-1])[order]
            self._ids[side].frombytes(old[side][_runs(ends[side][order], n)].tobytes())
            self._ends[side].frombytes(np.cumsum(n).tobytes())
        self._place = dict(zip(kept, range(len(kept))))
        self._same = bytearray(map(same.__getitem__, order.tolist()))
        self._uses = uses[order] // 2
        self._held = sum(map(len, kept)) + WORD_BYTES * len(kept)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of a blank and each text, and whether both give its bytes back."""
        spaced = [" " + text for text in texts]
        of_a = self._a.encode_batch_fast(spaced, add_special_tokens=False)
        for text, a, b in zip(spaced, of_a, self._b.encode(texts, num_threads=1)):
            data, a = text.encode(), a.ids
            same = data == b"".join(map(self.a_bytes.__getitem__, a))
            yield a, b, same and data == b"".join(map(self.b_bytes.__getitem__, b))

    def _learn(self, words: list[str]) -> None:
        for start in range(0, len(words), 256):
            part = words[start : start + 256]
            rows = self._at_once(part)
            if rows is None:
                for word, (a, b, same) in zip(part, self._encoded(part)):
                    self._keep([word], (np.array(a, "i4"), np.array(b, "i4")), ([len(a)], [len(b)]), same)
            else:
                self._keep(part, *rows, True)

    def _at_once(self, words: list[str]):
        """Ids of many words as one text and where each word's end; None if a
        tokenizer does not give them back."""
        ((a, b, same),) = self._encoded([" ".join(words)])
        if not same:
            return None
        ends = np.cumsum([len(word.encode()) + 1 for word in words])
        ids = np.array(a, dtype="i4"), np.array(b, dtype="i4")
        cuts = []
        for one, size in zip(ids, (self.a_size, self.b_size)):
            of_tokens = np.cumsum(size[one])
            cuts.append(np.searchsorted(of_tokens, ends) + 1)
            if not np.array_equal(of_tokens[cuts[-1] - 1], ends):
                return None
        return ids, cuts

    def _keep(self, words: list[str], ids, cuts, same: bool) -> None:
        first = len(self._same)
        self._place.update(zip(words, range(first, first + len(words))))
        for one, at, flat, ends in zip(ids, cuts, self._ids, self._ends):
            ends.frombytes((np.asarray(at, dtype="i8") + len(flat)).tobytes())
            flat.frombytes(one.tobytes())
        self._same.extend(bytes([same]) * len(words))
        self._held += sum(map(len, words)) + WORD_BYTES * len(words)

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of all texts behind each other for A and B, the number of ids in each text for A
        and B, and whether a text has tokens; without, it has no ids."""
        if self._held > MEMORY_BYTES:
            self._forget()
        known = self._place
        words = [text.split(" ") if text and self.by_words else [] for text in texts]
        places = [list(map(known.get, w)) for w in words]
        odd = [] if self.by_words else [i for i, text in enumerate(texts) if text]
        open_rows = [i for i, at in enumerate(places) if None in at]
        new: dict[str, None] = {}
        for i in open_rows:
            missing = dict.fromkeys(compress(words[i], map(_is_none, places[i])))
            if any(not word or word[0].isspace() or word[-1].isspace() for word in missing):
                odd.append(i)
                places[i] = []
            else:
                new.update(missing)
        if new:
            self._learn(list(new))
            for i in open_rows:
                if places[i]:
                    places[i] = list(map(known.__getitem__, words[i]))
        counts = np.array(list(map(len, places)), dtype=np.int64)
        at = np.fromiter(chain.from_iterable(places), dtype=np.int64, count=int(counts.sum()))
        doc = np.repeat(np.arange(len(texts)), counts)
        uses = np.bincount(at, minlength=len(self._same))
        uses[: len(self._uses)] += self._uses
        self._uses = uses
        same = np.frombuffer(bytes(self._same), dtype=np.uint8)
        good = np.array([bool(text) for text in texts], dtype=bool)
        good[doc[same[at] == 0]] = False
        extra = dict(zip(odd, self._encoded([texts[i] for i in odd])))
        for i, (_, _, fits) in extra.items():
            good[i] = fits
        kept = good[doc]
        at, doc = at[kept], doc[kept]
        out: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for side in (0, 1):
            ends = np.frombuffer(self._ends[side], dtype=np.int64)
            flat = np.frombuffer(self._ids[side], dtype=np.int32)
            first, n = ends[at], ends[at + 1] - ends[at]
            size = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
            ids = flat[_runs(first, n)]
            for i, row in extra.items():
                size[i] = len(row[side]) if row[2] else 0
            if extra:
                ids = _with_extra(ids, size, {i: row[side] for i, row in extra.items() if row[2]})
            out.append(ids)
            sizes.append(size)
        return out, sizes, good


def _is_none(value) -> bool:
    return value is None


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, … `` (``n[0]`` of them), ``first[1], …``"""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + n, n)


def _with_extra(ids: np.ndarray, size: np.ndarray, extra: dict[int, list[int]]) -> np.ndarray:
    """Ids of the documents in ``extra`` at their places between the others."""
    taken = np.zeros(len(size), dtype=bool)
    taken[list(extra)] = True
    out = np.empty(int(size.sum()), dtype=np.int32)
    inside = np.repeat(taken, size)
    out[~inside] = ids
    if extra:
        out[inside] = np.concatenate([np.array(extra[i], dtype=np.int32) for i in sorted(extra)])
    return out


def lockstep(
    a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, a_last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that end together.

    ``a_ends`` and ``b_ends`` ascend over all documents; document i has
    the tokens of A from ``a_first[i]`` to before ``a_last[i]``, and its last tokens of both kinds end together.
    """
    lanes = -(-(a_last - a_first) // LANE_TOKENS)
    within = _runs(np.zeros(len(lanes), dtype=np.int64), lanes)
    a = np.repeat(a_first, lanes) + LANE_TOKENS * within
    a_stop = np.minimum(a + LANE_TOKENS, np.repeat(a_last, lanes))
    # A lane has the tokens that end after its first byte and not after its last.
    before = np.where(a > 0, a_ends[a - 1], 0)
    b = np.searchsorted(b_ends, before, side="right")
    b_stop = np.searchsorted(b_ends, a_ends[a_stop - 1], side="right")
    links: list[np.ndarray] = []
    of_b: list[np.ndarray] = []
    active = (a < a_stop) & (b < b_stop)
    while True:
        if not active.all():
            a, b, a_stop, b_stop = a[active], b[active], a_stop[active], b_stop[active]
        if not len(a):
            break
        end_a, end_b = a_ends[a], b_ends[b]
        together = end_a == end_b
        links.append(a[together])
        of_b.append(b[together])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        active = (a < a_stop) & (b < b_stop)
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Steps come one after the other in all lanes; links follow the text.
    link_a, link_b = np.concatenate(links), np.concatenate(of_b)
    order = np.argsort(link_a, kind="stable")
    return link_a[order], link_b[order]


# What stands behind an id: another of its side, the first of B, the next group.
_SIGNS = b",|;"


class _Digits:
    """Ids as decimal text, each with a sign behind it."""

    def __init__(self, largest: int):
        text = [b"%d%c" % (i, sign) for i in range(largest + 1) for sign in _SIGNS]
        self.length = np.array(list(map(len, text)), dtype=np.int32)
        self._table = np.array(text).view(np.uint8).reshape(len(text), -1)

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        rows = self._table[cells].reshape(-1)
        return rows[rows != 0]


def written_groups(
    digits: _Digits, a_ids: np.ndarray, b_ids: np.ndarray, link_a: np.ndarray, link_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;`` behind each other, and where each group's text ends.

    A group's tokens of A and B go until its link; every token is in one.
    """
    a_groups = np.diff(link_a, prepend=-1)
    b_groups = np.diff(link_b, prepend=-1)
    of_a = np.repeat(np.arange(len(link_a)), a_groups)
    of_b = np.repeat(np.arange(len(link_b)), b_groups)
    # In front of a token of A stand the tokens of B in earlier groups, and so on.
    place_a = np.arange(len(a_ids)) + (link_b - b_groups + 1)[of_a]
    place_b = np.arange(len(b_ids)) + (link_a + 1)[of_b]
    cells = np.empty(len(a_ids) + len(b_ids), dtype=np.int32)
    cells[place_a], cells[place_b] = a_ids * len(_SIGNS), b_ids * len(_SIGNS)
    cells[place_a[link_a]] += _SIGNS.index(b"|")
    cells[place_b[link_b]] += _SIGNS.index(b";")
    ends = np.cumsum(digits.length[cells], dtype=np.int64)
    return digits(cells), ends[place_b[link_b]]


_known: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(merges_file: str, pieces_file: str) -> Tokenizers:
    """One per Python worker."""
    key = (merges_file, pieces_file)
    if key not in _known:
        _known[key] = Tokenizers(*key)
    return _known[key]


_ADDED = "n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>"


def align(docs: DataFrame, merges_file: str, pieces_file: str, text_col: str = "text") -> DataFrame:
    """Add tokens, groups and links to every row.

    ``n_a, n_b`` are its tokens, ``groups`` the ids of each group as text
    (``a1,a2|b1;a3|b2,b3``), ``n_groups`` their number, and ``links`` the linked
    ids in the order of the text, each pair as ``a << B_BITS | b``.
    """
    at = docs.columns.index(text_col)

    def task():
        encode = tokenizers(merges_file, pieces_file)
        digits = _Digits(max(len(encode.a_bytes), len(encode.b_bytes)))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            (a_ids, b_ids), (n_a, n_b), _ = encode(batch.column(at).to_pylist())
            a_ends, b_ends = np.cumsum(encode.a_size[a_ids]), np.cumsum(encode.b_size[b_ids])
            a_last = np.cumsum(n_a)
            link_a, link_b = lockstep(a_ends, b_ends, a_last - n_a, a_last)
            text, ends = written_groups(digits, a_ids, b_ids, link_a, link_b)
            n_links = np.bincount(
                np.searchsorted(a_last, link_a, side="right"), minlength=len(n_a)
            )
            pairs = (a_ids[link_a].astype(np.int64) << B_BITS) | b_ids[link_b]
            offsets = np.concatenate(([0], np.cumsum(n_links)))
            cuts = np.concatenate(([0], ends))[offsets].tolist()
            data = text.tobytes()
            groups = [data[i : max(i, j - 1)].decode() for i, j in zip(cuts, cuts[1:])]
            return [
                pa.array(n_a),
                pa.array(n_b),
                pa.array(n_links, pa.int64()),
                pa.array(groups, pa.string()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs)),
            ]

        return work

    return add_columns(docs, _ADDED, task, bounded=text_col, size=BATCH_BYTES)


def most_pairs(merges_file: str, pieces_file: str) -> int:
    """How many pairs of ids can be linked at all.

    The bytes of one end the bytes of the other, so that pairs are bounded by
    the vocabularies whatever the texts.
    """
    encode, out = tokenizers(merges_file, pieces_file), 0
    sides = (encode.a_bytes, encode.b_bytes)
    for one, other, least in ((*sides, 0), (*sides[::-1], 1)):
        number = Counter(filter(None, other))
        out += sum(number[token[i:]] for token in filter(None, one) for i in range(least, len(token)))
    return out


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: links of each pair of ids over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As many entries as pairs can be linked, see most_pairs.
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for start in range(0, len(flat), 1 << 20):
                new, n = np.unique(flat[start : start + (1 << 20)], return_counts=True)
                both, where = np.unique(np.concatenate((pairs, new)), return_inverse=True)
                summed = np.bincount(where, weights=np.concatenate((counts, n)), minlength=len(both))
                pairs, counts = both, summed.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    parts = aligned.select("links").mapInArrow(run, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, merges_file: str, pieces_file: str) -> DataFrame:
    """Add ``n_links``, ``n_best`` and ``count_sum`` to aligned rows.

    The counts of all pairs go to every task; :func:`most_pairs` bounds them
    by the vocabularies, not by the texts.
    """
    spark = aligned.sparkSession
    found = pair_counts(aligned).toArrow().sort_by("pair")
    pairs, counts = (found.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    if len(pairs) > most_pairs(merges_file, pieces_file):
        raise ValueError("links of other tokenizers")
    highest = np.zeros(int((pairs & ((1 << B_BITS) - 1)).max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(highest, pairs & ((1 << B_BITS) - 1), counts)
    best = counts == highest[pairs & ((1 << B_BITS) - 1)]
    shared = spark.sparkContext.broadcast((pairs, counts, best))
    at = aligned.columns.index("links")

    def task():
        pairs, counts, best = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            links = batch.column(at)
            flat = links.flatten().to_numpy(zero_copy_only=False)
            n = np.asarray(links.value_lengths().fill_null(0))
            ends = np.concatenate(([0], np.cumsum(n)))
            where = np.searchsorted(pairs, flat)
            sums = [np.concatenate(([0], np.cumsum(x[where]))) for x in (best, counts)]
            return [pa.array(n, pa.int64()), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)]

        return work

    return add_columns(aligned, "n_links bigint, n_best bigint, count_sum bigint", task)
