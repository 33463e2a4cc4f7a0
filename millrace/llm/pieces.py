"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file:

* the normaliser: an arc without input that puts a blank sign in front, arcs from a
  blank and from the blank sign to the blank sign, and identity arcs for the rest;
* the pieces: states and arcs of a trie, characters in, one id out at its last
  state, at a weight;
* byte fallback: an arc for a character that is no piece; out come the ids of its
  UTF-8 bytes, or the unknown id (neighbouring ones are one).

The first two are composed when the model is compiled: characters that the normaliser
makes one are one label.  The result is composed with each input to a lattice of
positions, and the ids are read off its shortest path in the tropical semiring
(weights add along a path, the least sum wins, of equal ones the arc that begins
further left).

* Unigram models: a piece weighs minus its score.  (The library adds in 32 bits over the
  whole text; where its sums round to a tie, it may take the other of two equal paths.)
* Merge (BPE) models: a piece weighs 1, and the pieces are composed with an
  acceptor of neighbours.  Its states are pieces; an arc to a piece weighs nothing
  where merging would leave the two side by side, and has infinite weight where it
  would not.  A sequence is the result of merging exactly if all its neighbours
  pass, so that one path of finite weight leads to every position.

The new words of many texts are composed and relaxed together, position by position,
one arc of all words at a time.  Words are remembered within a task, in bounded space.
A word of more than ``LONG`` characters falls apart where no piece goes across; what is
longer even so is relaxed alone, by the same rule.

NULL and empty texts have no ids; equal texts have equal ids; an empty table stays
empty; results take the place of input columns of their name.  Texts of any length are
encoded whole.  Characters the model cannot tell apart (the blank sign and a blank)
come back as blanks.  Models whose normaliser is not the one above are refused.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from millrace.llm.common import add_columns

BLANK = "▁"
# Characters of remembered words in a task; a word counts as some more.
REMEMBERED = 1 << 24
WORD_COST = 32
# Longest word that is relaxed together with others.
LONG = 64
# Bytes of text whose new words are solved together.
BYTES_TOGETHER = 1 << 20
# Places for remembered pairs of neighbours, as a power of two.
PAIR_BITS = 21

# Fixed values of the model format: kinds of models and of pieces, and how far
# an unknown character is below the least score.
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNKNOWN_PENALTY = 10.0

_WORD = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")
_NO_ID = -1
_SCATTER = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """A compiled model: encodes and decodes texts."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisers are supported")
        if trainer.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and merge models are supported")
        if trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("blanks must lead the word they belong to")
        self._prefix = " " if spec.add_dummy_prefix else ""
        self._merges = trainer.model_type == _BPE
        self._pieces = [p.piece for p in proto.pieces]
        self._scores = [p.score for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        if _USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        self._ids = {p: i for i, p in enumerate(self._pieces) if kinds[i] == _NORMAL}
        if any(BLANK in piece.lstrip(BLANK) for piece in self._ids):
            raise ValueError("a piece holds a blank that does not lead it")
        self._bytes = {int(p[3:5], 16): i for i, p in enumerate(self._pieces) if kinds[i] == _BYTE}
        self._unknown = kinds.index(_UNKNOWN)
        # Neighbouring characters inside pieces: elsewhere a lattice falls apart.
        self._inside = {p[i : i + 2] for p in self._ids for i in range(len(p) - 1)}
        self._outputs = [self._output(p, kind) for p, kind in zip(self._pieces, kinds)]
        self._none = len(self._pieces)  # stands for a character that is no piece
        self._compile()
        self._spines: dict[int, tuple[list, list] | None] = {}
        # Each pair of neighbours has one place: the pair, and whether it passes.
        self._pairs = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self._solved: dict[str | tuple[str], bytes] = {}
        self._held = 0

    def _compile(self) -> None:
        """States, arcs and weights of the pieces behind the normaliser; state 0 starts."""
        letters = sorted({char for piece in self._ids for char in piece})
        self._label = np.zeros(0x110000, dtype=np.int32)  # 0: no piece has the character
        self._label[[ord(char) for char in letters]] = np.arange(1, len(letters) + 1)
        self._label[ord(" ")] = self._label[ord(BLANK)]
        self._n_labels = len(letters) + 1
        arcs: dict[int, int] = {}
        final = [self._none]
        for piece, i in self._ids.items():
            state = 0
            for label in self._label[[ord(char) for char in piece]].tolist():
                state = arcs.setdefault(state * self._n_labels + label, len(final))
                if state == len(final):
                    final.append(self._none)
            final[state] = i
        self._arcs, self._final = arcs, np.array(final)
        keys = np.fromiter(arcs, np.int64, len(arcs))
        order = np.argsort(keys)
        self._arc_keys = keys[order]
        self._arc_ends = np.fromiter(arcs.values(), np.int64, len(arcs))[order]
        least = min((self._scores[i] for i in self._ids.values()), default=0.0)
        if self._merges:
            self._weights = np.ones(self._none + 1)
        else:
            self._weights = -np.array([*self._scores, least - _UNKNOWN_PENALTY])

    def _output(self, piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == _CONTROL:
            return b""
        if kind == _UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(BLANK, " ").encode()

    # Byte fallback and the acceptor of neighbours.

    def _fallback(self, char: str) -> list[int]:
        if not self._bytes:
            return [self._unknown]
        char = BLANK if char == " " else char
        return [self._bytes[b] for b in char.encode("utf-8", "replace")]

    def _merge_rank(self, piece: int) -> float:
        return -self._scores[piece]

    def _spine(self, piece: int):
        """``(left, right)`` edges of a piece while it is merged together.

        Each is a list of ``(text, until)``: what stands at that edge, and the
        rank of the merge that ends it.  None if merging never makes the piece.
        """
        if piece not in self._spines:
            parts = list(self._pieces[piece])
            left, right = [[parts[0], math.inf]], [[parts[-1], math.inf]]
            while len(parts) > 1:
                ranks = [self._ids.get(a + b, _NO_ID) for a, b in zip(parts, parts[1:])]
                ranks = [math.inf if i == _NO_ID else self._merge_rank(i) for i in ranks]
                rank = min(ranks)
                if rank == math.inf:
                    break
                at = ranks.index(rank)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left[-1][1] = rank
                    left.append([parts[0], math.inf])
                if at == len(parts) - 1:
                    right[-1][1] = rank
                    right.append([parts[-1], math.inf])
            self._spines[piece] = (left, right) if len(parts) == 1 else None
        return self._spines[piece]

    def _may_meet(self, one: int, other: int) -> bool:
        """Whether merging leaves the two pieces side by side.

        It does not if, at some moment, what stands on either side of their
        border would merge before either is used up.  Ranks are times, since a
        merge comes after those that made its parts; of equal ranks, the one
        further left comes first.  Nothing merges with a character that is no piece.
        """
        spines = [self._spine(piece) for piece in (one, other) if piece != self._none]
        if None in spines:
            return False
        if len(spines) < 2:
            return True
        before = -math.inf
        right, left = spines[0][1], spines[1][0]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = right[i], left[j]
            merged = self._ids.get(a + b, _NO_ID)
            if merged != _NO_ID:
                rank = self._merge_rank(merged)
                if before <= rank < a_until and rank <= b_until:
                    return False
            if a_until == b_until == math.inf:
                return True
            before = min(a_until, b_until)
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _meeting(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weights of the acceptor's arcs: 0 where neighbours pass, infinite elsewhere."""
        pairs = left * (self._none + 1) + piece
        places = (pairs.astype(np.uint64) * _SCATTER >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self._pairs[places]
        new = np.flatnonzero(known >> 1 != pairs)
        if len(new):
            asked, which = np.unique(pairs[new], return_inverse=True)
            both = zip(*(part.tolist() for part in np.divmod(asked, self._none + 1)))
            passes = [self._may_meet(one, other) for one, other in both]
            known[new] = (asked << 1 | np.array(passes, dtype=np.int64))[which]
            self._pairs[places[new]] = known[new]
        return np.where(known & 1 == 1, 0.0, np.inf)

    # Composition and shortest path.

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids on the shortest paths through the lattices of many words.

        ``weight``, ``last`` and ``begin`` say for every position of every word the
        least weight of a path to it, the piece at its end and where that begins.
        """
        if not words:
            return []
        order = np.argsort([-len(word) for word in words], kind="stable")
        words = [words[i] for i in order.tolist()]
        lengths = np.array([len(word) for word in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        labels = self._label[codes].astype(np.int64)
        first = np.cumsum(lengths) - lengths
        origin = first + np.arange(len(words))  # a position more than characters
        weight = np.full(len(codes) + len(words), np.inf)
        last = np.full(len(weight), self._none)
        begin = np.zeros(len(weight), dtype=np.int64)
        weight[origin] = 0.0
        for start in range(int(lengths[0])):
            lane = np.arange(np.searchsorted(-lengths, -start))  # the words that go on
            state = np.zeros(len(lane), dtype=np.int64)
            span = 0
            while len(lane):
                key = state * self._n_labels + labels[first[lane] + start + span]
                span += 1
                at = np.searchsorted(self._arc_keys, key)
                at[at == len(self._arc_keys)] = 0
                passed = self._arc_keys[at] == key
                state = self._arc_ends[at]
                piece = np.where(passed, self._final[state], self._none)
                # The fallback arc takes a character that is no piece.
                arc = np.flatnonzero(piece != self._none) if span > 1 else np.arange(len(lane))
                source, piece = origin[lane[arc]] + start, piece[arc]
                total = weight[source] + self._weights[piece]
                if self._merges:
                    total += self._meeting(last[source], piece)
                less = np.flatnonzero(total < weight[source + span])
                target = source[less] + span
                weight[target], last[target], begin[target] = total[less], piece[less], source[less]
                on = np.flatnonzero(passed & (lengths[lane] > start + span))
                lane, state = lane[on], state[on]
        path = np.zeros(len(weight), dtype=bool)
        begins = np.zeros(len(weight), dtype=bool)
        begins[origin] = True
        here = origin + lengths
        while len(here):
            path[here] = True
            here = begin[here]
            here = here[~begins[here]]
        # Positions on the paths are in the order of their words already.
        counts = np.add.reduceat(path, origin, dtype=np.int64)
        at = np.flatnonzero(path)
        out = [b""] * len(words)
        rows = self._read_off(last[at], codes[at - 1 - np.repeat(np.arange(len(words)), counts)], counts)
        for i, row in zip(order.tolist(), rows):
            out[i] = row
        return out

    def _read_off(self, ids: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids by word; ``codes`` are the last characters of the pieces."""
        missing = np.flatnonzero(ids == self._none)
        if len(missing):
            spelled = [self._fallback(chr(code)) for code in codes[missing].tolist()]
            times = np.ones(len(ids), dtype=np.int64)
            times[missing] = [len(row) for row in spelled]
            word = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(word, weights=times, minlength=len(counts)).astype(np.int64)
            ids = np.repeat(ids, times)
            ids[ids == self._none] = list(chain.from_iterable(spelled))
        data = ids.astype("<i4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _alone(self, word: str) -> bytes:
        """The same for one long word."""
        labels = self._label[[ord(char) for char in word]].tolist()
        arcs, final, n = self._arcs, self._final, len(word)
        weight, last, begin = [0.0] + [math.inf] * n, [self._none] * (n + 1), [0] * (n + 1)
        passing: dict[tuple[int, int], bool] = {}
        for start in range(n):
            state: int | None = 0
            for end in range(start + 1, n + 1):
                state = arcs.get(state * self._n_labels + labels[end - 1])
                piece = self._none if state is None else int(final[state])
                if piece != self._none or end == start + 1:
                    total = weight[start] + float(self._weights[piece])
                    if total < weight[end]:
                        pair = last[start], piece
                        if self._merges and pair not in passing:
                            passing[pair] = self._may_meet(*pair)
                        if not self._merges or passing[pair]:
                            weight[end], last[end], begin[end] = total, piece, start
                if state is None:
                    break
        path, here = [], n
        while here:
            path.append(here)
            here = begin[here]
        ids = np.array([last[end] for end in path[::-1]])
        codes = np.array([ord(word[end - 1]) for end in path[::-1]])
        return self._read_off(ids, codes, np.array([len(ids)]))[0]

    def _parts(self, word: str) -> list[str]:
        """A long word, cut where no piece goes across."""
        plain = word.replace(" ", BLANK)
        cuts = [i for i in range(1, len(word)) if plain[i - 1 : i + 1] not in self._inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _solve(self, words: list[str]) -> list[bytes]:
        cut = {i: self._parts(word) for i, word in enumerate(words) if len(word) > LONG}
        if not cut:
            return self._together(words)
        parts = list(chain.from_iterable(cut.get(i, (word,)) for i, word in enumerate(words)))
        short = iter(self._together([part for part in parts if len(part) <= LONG]))
        solved = iter([next(short) if len(part) <= LONG else self._alone(part) for part in parts])
        return [b"".join(islice(solved, len(cut.get(i, (0,))))) for i in range(len(words))]

    def _words(self, text: str) -> list[str | tuple[str]]:
        """The words of a text without the blank that leads each, or in a tuple without one.

        No piece goes from another character to a blank, so words stand alone.
        """
        plain = "  " not in text and BLANK not in text and " " not in (text[0], text[-1])
        if self._prefix and plain:
            return text.split(" ")
        found = _WORD.findall(self._prefix + text)
        return [word[1:] if word[0] in (" ", BLANK) else (word,) for word in found]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        words = [self._words(text) if text else [] for text in texts]
        needed = set(chain.from_iterable(words))
        if self._held > REMEMBERED:
            self._solved = {word: self._solved[word] for word in needed.intersection(self._solved)}
            self._held = sum(WORD_COST + len(word) for word in self._solved)
        new = list(needed.difference(self._solved))
        whole = [" " + word if isinstance(word, str) else word[0] for word in new]
        self._solved.update(zip(new, self._solve(whole)))
        self._held += sum(WORD_COST + len(word) for word in whole)
        rows = [b"".join([self._solved[word] for word in row]) for row in words]
        return rows if self._bytes else [self._one_unknown(row) for row in rows]

    def _one_unknown(self, row: bytes) -> bytes:
        ids = np.frombuffer(row, dtype="<i4")
        again = (ids[1:] == self._unknown) & (ids[:-1] == self._unknown)
        return ids[np.append(True, ~again)[: len(ids)]].tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Drop what was remembered of texts; the model stays."""
        self._solved, self._held = {}, 0

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that are no text become U+FFFD."""
        outputs = self._outputs
        text = b"".join([outputs[i] for i in np.frombuffer(ids, dtype="<i4").tolist()])
        text = text.decode("utf-8", "replace")
        return text[1:] if self._prefix and text[:1] == " " else text


_compiled: dict[str, Transducer] = {}


def compiled(model_file: str) -> Transducer:
    """One per Python worker."""
    if model_file not in _compiled:
        with open(model_file, "rb") as file:
            _compiled[model_file] = Transducer(file.read())
    return _compiled[model_file]


def encode(
    docs: DataFrame, model_file: str, text_col: str = "text", decoded: str | None = None
) -> DataFrame:
    """Add ``ids`` and ``n_tokens``, and as column ``decoded`` the text of the ids.

    ``model_file`` is a place that every executor can open, as for any other
    installed resource.
    """

    def task():
        transducer = compiled(model_file)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = transducer.encode_all(batch.column(text_col).to_pylist())
            ends = [0, *accumulate(len(row) // 4 for row in rows)]
            ids = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"))
            columns = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
                pa.array(np.diff(ends), pa.int64()),
            ]
            if decoded is not None:
                columns.append(pa.array([transducer.decode(row) for row in rows], pa.string()))
            return columns

        # The worker lives on and goes to other stages.
        work.close = transducer.forget
        return work

    added = "ids array<int>, n_tokens bigint"
    if decoded is not None:
        added = f"{added}, {decoded} string"
    return add_columns(docs, added, task, bounded=text_col, size=BYTES_TOGETHER)


def decode(docs: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of ``ids_col`` as column ``out``; NULL has no ids."""

    def task():
        transducer = compiled(model_file)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(ids_col)
            rows = [np.asarray(row, dtype="<i4") for row in _rows(column)]
            return [pa.array([transducer.decode(row.tobytes()) for row in rows], pa.string())]

        return work

    return add_columns(docs, f"{out} string", task)


def _rows(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_pylist()
    return [
        values[a:b] if valid else values[:0]
        for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist())
    ]
