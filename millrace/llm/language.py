"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram is bound by
multiplying its letters' vectors, each permuted (rotated) by its place; a text
is the bundle (sum) of its n-grams, and a language the bundle of its texts.  A
text gets the language whose prototype is nearest by cosine.

Letters are compared in lower case, and a stretch of other characters counts as
one blank, so that n-grams know where words begin and end.  NULL texts and texts
without a letter are ``und`` with score 0, as is everything if no language was
learned.  Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_columns, mix, slices

GRAM = 3
DIMENSION = 1024
UNKNOWN = "und"

# Codes of n-grams whose vectors a task keeps; others are made when met.
MAX_KEPT = 1 << 15

# Bits per character in the code of an n-gram.
_CHAR_BITS = 21


def _letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or a blank.

    A letter whose lower case is several characters stays as it is.
    """
    table = np.full(0x110000, 32, dtype=np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


class Profiles:
    """Vectors of n-grams and bundles of texts."""

    def __init__(self, gram: int = GRAM, dimension: int = DIMENSION):
        self.gram, self.dimension = gram, dimension
        self._letters: dict[int, np.ndarray] = {}
        self._table = _letter_table()
        self._known = np.zeros(0, dtype=np.int64)  # sorted codes
        self._place = np.zeros(0, dtype=np.int64)  # of their vectors
        self._vectors = np.empty((MAX_KEPT, dimension), dtype=np.float32)

    def letters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self._table[codes]
        blank = codes == 32
        # One blank between words and at both ends.
        kept = codes[~(blank & np.concatenate(([True], blank[:-1])))] if len(codes) else codes
        last = [32] if len(kept) and kept[-1] != 32 else kept[:0]
        return np.concatenate(([32], kept, last))

    def grams(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes and how often each occurs."""
        n = len(letters) - self.gram + 1
        code = np.zeros(max(n, 0), dtype=np.int64)
        for place in range(self.gram if n > 0 else 0):
            code = (code << _CHAR_BITS) | letters[place : place + n].astype(np.int64)
        return np.unique(code, return_counts=True)

    def letter(self, char: int) -> np.ndarray:
        """The random vector of a letter, the same in every task."""
        if char not in self._letters:
            seed = np.uint64(char << 32) + np.arange(self.dimension, dtype=np.uint64)
            self._letters[char] = np.where(mix(seed) & np.uint64(1), 1, -1).astype(np.int8)
        return self._letters[char]

    def bind(self, code: int) -> np.ndarray:
        """The n-gram's vector: letters rotated by their place, multiplied."""
        out = np.ones(self.dimension, dtype=np.int8)
        for place in range(self.gram):
            char = (code >> (_CHAR_BITS * (self.gram - 1 - place))) & ((1 << _CHAR_BITS) - 1)
            out = out * np.roll(self.letter(char), place)
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of n-gram vectors, each as often as it occurs."""
        total = np.zeros(self.dimension, dtype=np.float64)
        for first in range(0, len(codes), MAX_KEPT // 4):
            part = slice(first, first + MAX_KEPT // 4)
            total += counts[part].astype(np.float32) @ self._of(codes[part])
        return total

    def _of(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._known, codes)
        found = at < len(self._known)
        found[found] = self._known[at[found]] == codes[found]
        if not found.all():
            new = codes[~found]
            if len(self._known) + len(new) > MAX_KEPT:
                self._known, self._place, new = self._known[:0], self._place[:0], codes
            place = np.arange(len(self._known), len(self._known) + len(new))
            for row, code in zip(place.tolist(), new.tolist()):
                self._vectors[row] = self.bind(code)
            at = np.searchsorted(self._known, new)
            self._known = np.insert(self._known, at, new)
            self._place = np.insert(self._place, at, place)
            at = np.searchsorted(self._known, codes)
        return self._vectors[self._place[at]]

    def of_text(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text; None if it has no letter."""
        letters = self.letters(text or "")
        if not (letters != 32).any():
            return None
        return self.bundle(*self.grams(letters))


_profiles: dict[tuple[int, int], Profiles] = {}


def profiles(gram: int, dimension: int) -> Profiles:
    """One per Python worker: the letter table takes a moment to make."""
    if (gram, dimension) not in _profiles:
        _profiles[gram, dimension] = Profiles(gram, dimension)
    return _profiles[gram, dimension]


def prototypes(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    gram: int = GRAM,
    dimension: int = DIMENSION,
) -> tuple[list[str], np.ndarray]:
    """Learn languages: names in order, and one bundle each.

    Each task bundles its texts by language; one vector per task and language
    is added up.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = profiles(gram, dimension), {}
        for batch in slices(batches):
            for text, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "lang"))):
                bundle = made.of_text(text)
                if bundle is not None:
                    sums[lang] = sums[lang] + bundle if lang in sums else bundle
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()),
                pa.array([row.tolist() for row in sums.values()], pa.list_(pa.float64())),
            ],
            names=["lang", "bundle"],
        )

    per_task = (
        docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .filter("text is not null and lang is not null")
        .mapInArrow(run, "lang string, bundle array<double>")
    )
    summed = (
        per_task.select("lang", F.posexplode("bundle").alias("place", "x"))
        .groupBy("lang", "place")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("parts"))
        .orderBy("lang")
        .collect()
    )
    vectors = [[part["x"] for part in row["parts"]] for row in summed]
    return [row["lang"] for row in summed], np.array(vectors).reshape(len(summed), dimension)


def identify(
    docs: DataFrame,
    languages: list[str],
    vectors: np.ndarray,
    text_col: str = "text",
    gram: int = GRAM,
    dimension: int = DIMENSION,
) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine moved into 0 to 1."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(lengths == 0, 1, lengths)

    def task():
        made = profiles(gram, dimension)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            langs, scores = [], []
            for text in batch.column(text_col).to_pylist():
                bundle = made.of_text(text) if languages else None
                if bundle is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = unit @ bundle / (np.linalg.norm(bundle) or 1.0)
                top = int(cosines.argmax())
                langs.append(languages[top])
                scores.append(float(min(1.0, max(0.0, (cosines[top] + 1) / 2))))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return add_columns(docs, "lang_pred string, score double", task)
