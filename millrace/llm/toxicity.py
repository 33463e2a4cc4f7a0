"""Toxicity by a weighted lexicon, matched with one Aho-Corasick automaton.

Texts are folded first: compatibility forms, case and invisible characters go, letters that
look Latin become Latin, and digits and signs that stand in for letters become
those letters (``i`` and ``l`` are one letter, since 1 stands for both).  The
lexicon holds words and word beginnings with weights; a match inside an
exception phrase does not count.  Phrases are learned with the weights: a
lexicon word and the words next to it, where clean documents have them in
several surroundings, too often by the error of the counts for a term of the lexicon.
The weights found, alone and per word of the
text, go through a logistic curve to a score between 0 and 1.

NULL and empty texts have no matches and get the score of a text without any.
Rows that occur twice are scored alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_columns, slices

# Labelled rows that weights and curve are learned from, at most; chosen by a
# hash of their id.
MAX_LABELLED = 16_000
MAX_TERMS = 20_000
MIN_CONTEXTS = 4
MIN_WEIGHT = 2.5
STEMS = (5, 7)

# Cyrillic and Greek letters by the Latin ones they look like.
_LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g",
    "н": "h", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "и": "u", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
}

# Digits and signs by the letters they stand in for.
_STANDS_FOR = {
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e",
}

_HOMOGLYPHS = {ord(a): b for a, b in _LOOKS_LIKE.items()} | {ord("l"): "i", ord("ı"): "i"}
_SUBSTITUTES = {ord(a): b for a, b in _STANDS_FOR.items()}
# A sign is a letter only where a letter follows; at a word's end it is a sign.
_RUN = re.compile(r"(?:[^\W_]|[@$!|+€](?=[^\W_]))+")
_LETTER = re.compile(r"[^\W\d_]")
_MAX_CACHED = 1 << 17


def fold_token(token: str) -> str:
    """Folded words of a token, one space between them."""
    plain = unicodedata.normalize("NFKC", token).casefold()
    if not plain.isascii():
        plain = "".join(c for c in plain if unicodedata.category(c) != "Cf")
    plain = plain.translate(_HOMOGLYPHS)
    words = []
    for run in _RUN.findall(plain):
        words.append(run.translate(_SUBSTITUTES) if _LETTER.search(run) else run)
    return " ".join(words)


class Folder:
    """Folds texts token by token and remembers tokens."""

    def __init__(self):
        self._seen: dict[str, str] = {}

    def __call__(self, text: str | None) -> str:
        seen, tokens = self._seen, (text or "").split()
        if len(seen) > _MAX_CACHED:
            seen.clear()
        for token in set(tokens).difference(seen):
            seen[token] = fold_token(token)
        words = " ".join(map(seen.__getitem__, tokens)).split()
        return f" {' '.join(words)} "


@dataclass(frozen=True)
class Lexicon:
    """Patterns begin with a space; whole words and phrases end with one too."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-2.0, 1.0, 1.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self._curve = lexicon.curve
        automaton = ahocorasick.Automaton()
        for pattern, weight in lexicon.weights.items():
            automaton.add_word(pattern, (len(pattern), weight))
        for phrase in lexicon.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        self._automaton = automaton if len(automaton) else None
        if self._automaton:
            automaton.make_automaton()

    def weight(self, folded: str) -> tuple[float, int]:
        """Summed weight and number of the words that match."""
        if self._automaton is None:
            return 0.0, 0
        at: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self._automaton.iter(folded):
            begin = end - size + 1
            if weight is None:
                excused.append((begin, end))
            elif weight > at.get(begin, -math.inf):
                at[begin] = weight
        excused.sort()
        starts, reach = [a for a, _ in excused], [-1, *accumulate((b for _, b in excused), max)]
        counted = [w for begin, w in at.items() if begin >= reach[bisect_right(starts, begin)]]
        return math.fsum(sorted(counted)), len(counted)

    def measures(self, folded: str) -> tuple[float, float]:
        """Weight of the matches, and weight per word, both damped."""
        weight, _ = self.weight(folded)
        n_words = max(1, folded.count(" ") - 1)
        return math.log1p(max(0.0, weight)), math.log1p(100 * max(0.0, weight) / n_words)

    def score(self, folded: str) -> float:
        base, by_weight, by_density = self._curve
        weight, density = self.measures(folded)
        return 1 / (1 + math.exp(-(base + by_weight * weight + by_density * density)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = MAX_LABELLED
) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled documents."""
    chosen = (
        labels.select("doc_id", F.col(label_col).cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def terms(folded: str) -> Iterator[tuple[str, str]]:
    """Each word and its beginnings as patterns, with the words around it."""
    words = folded.split()
    for i, word in enumerate(words):
        around = " ".join((words[i - 1] if i else "", *words[i + 1 : i + 2]))
        if len(word) > 2:
            yield f" {word} ", around
        for size in STEMS:
            if len(word) > size:
                yield f" {word[:size]}", around


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per half of the sample: contexts of toxic terms, documents of clean ones."""
    folder, clean, toxic = Folder(), Counter(), set()
    for batch in slices(batches):
        columns = (batch.column(name).to_pylist() for name in ("text", "label", "half"))
        for text, label, half in zip(*columns):
            found = dict(terms(folder(text)))
            if label == 1:
                toxic.update((term, half, around) for term, around in found.items())
            else:
                clean.update((term, half) for term in found)
    rows = [(term, half, around, 0) for term, half, around in toxic]
    rows += [(term, half, None, n) for (term, half), n in clean.items()]
    for start in range(0, len(rows), 20_000):
        columns = list(zip(*rows[start : start + 20_000]))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=["term", "half", "around", "clean"],
        )


def _weights(counts: np.ndarray, sizes: tuple[int, int], errors: int = -1) -> np.ndarray:
    """Log odds of terms in toxic against clean documents, less their error (or more)."""
    toxic, clean = counts[:, 0] + 0.5, counts[:, 1] + 0.5
    odds = np.log(toxic / (sizes[0] + 1)) - np.log(clean / (sizes[1] + 1))
    return odds + errors * np.sqrt(1 / toxic + 1 / clean)


def learn(sample: DataFrame, exceptions: Iterable[str] = ()) -> Lexicon:
    """Weights and curve from ``(doc_id, text, label)``.

    Of a term in toxic documents, different surroundings are counted, one per
    document, so that the words of a text that was copied often do not pass
    for toxic.  The curve is fitted to weights that each half of the sample
    gets from the lexicon of the other half.
    """
    halves = sample.select(
        "text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    )
    n = {(r["half"], r["label"]): r["count"] for r in halves.groupBy("half", "label").count().collect()}
    sizes = np.array([[n.get((half, label), 0) for label in (1, 0)] for half in (0, 1)])
    toxic, clean = F.countDistinct("around"), F.coalesce(F.sum("clean"), F.lit(0))
    counted = (
        halves.mapInArrow(_count_terms, "term string, half int, around string, clean bigint")
        .groupBy("term", "half")
        .agg(toxic.alias("toxic"), clean.alias("clean"))
        .groupBy("term")
        .agg(
            *[
                F.sum(F.when(F.col("half") == half, F.col(c)).otherwise(0)).alias(f"{c}{half}")
                for half in (0, 1)
                for c in ("toxic", "clean")
            ]
        )
        .withColumn("toxic", F.col("toxic0") + F.col("toxic1"))
        .filter((F.col("toxic") >= MIN_CONTEXTS))
        .filter(
            F.col("toxic") * int(sizes[:, 1].sum() + 1)
            > 4 * (F.col("clean0") + F.col("clean1")) * int(sizes[:, 0].sum() + 1)
        )
        .orderBy(F.col("toxic").desc(), "term")
        .limit(MAX_TERMS)
        .select("term", "toxic0", "clean0", "toxic1", "clean1")
        .collect()
    )
    names = [row["term"] for row in counted]
    counts = np.array([[*row][1:] for row in counted], dtype=np.float64).reshape(-1, 2, 2)
    folder = Folder()
    given = tuple(folder(phrase) for phrase in exceptions)

    def weights(of: np.ndarray, n_docs: np.ndarray, least: int) -> dict[str, float]:
        found = _weights(of, tuple(n_docs.tolist()))
        kept = np.flatnonzero((found >= MIN_WEIGHT) & (of[:, 0] >= least))
        return {names[i]: float(found[i]) for i in kept}

    by_half = [weights(counts[:, half], sizes[half], MIN_CONTEXTS // 2) for half in (0, 1)]
    whole = weights(counts.sum(axis=1), sizes.sum(axis=0), MIN_CONTEXTS)
    learned = _exceptions(halves, {*whole, *by_half[0], *by_half[1]}, sizes)
    of_halves = [
        Lexicon(of_half, (*given, *phrases)) for of_half, phrases in zip(by_half, learned[:2])
    ]
    return Lexicon(whole, (*given, *learned[2]), _curve(halves, of_halves[::-1]))


def phrases(folded: str, patterns: set[str]) -> Iterator[tuple[str, str]]:
    """Each word that matches with the words next to it, and the words around these."""
    words = folded.split()
    for i, word in enumerate(words):
        if f" {word} " in patterns or any(f" {word[:size]}" in patterns for size in STEMS if len(word) > size):
            for first, end in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2)):
                if first >= 0 and end <= len(words):
                    around = " ".join((words[first - 1] if first else "", *words[end : end + 1]))
                    yield f" {' '.join(words[first:end])} ", around


def _exceptions(
    halves: DataFrame, patterns: set[str], sizes: np.ndarray
) -> tuple[list[str], list[str], list[str]]:
    """Exception phrases of each half of the sample, and of the whole.

    A term enters the lexicon where its log odds less their error reach
    ``MIN_WEIGHT``; a phrase around it excuses it where the log odds of the phrase do not
    reach that even with their error added, and clean texts have it in two surroundings.
    As with terms, different surroundings count, one per document, so that a clean text
    that was copied often excuses nothing.
    """
    if not patterns:
        return [], [], []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, found = Folder(), set()
        for batch in slices(batches):
            columns = (batch.column(name).to_pylist() for name in ("text", "label", "half"))
            for text, label, half in zip(*columns):
                in_text = dict(phrases(folder(text), patterns))
                found.update((phrase, half, label == 1, around) for phrase, around in in_text.items())
        rows = list(found)
        for start in range(0, len(rows), 20_000):
            columns = zip(*rows[start : start + 20_000])
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                names=["phrase", "half", "toxic", "around"],
            )

    rows = (
        halves.mapInArrow(run, "phrase string, half int, toxic boolean, around string")
        .groupBy("phrase")
        .agg(
            *[
                F.countDistinct(F.when(F.col("half").isin(halves_of) & toxic, F.col("around")))
                for halves_of in ([0], [1], [0, 1])
                for toxic in (F.col("toxic"), ~F.col("toxic"))
            ]
        )
        .toDF("phrase", "toxic0", "clean0", "toxic1", "clean1", "toxic", "clean")
        .filter("clean >= 2")
        .orderBy("phrase")
        .collect()
    )
    names = [row["phrase"] for row in rows]
    counts = np.array([[*row][1:] for row in rows], dtype=np.float64).reshape(-1, 3, 2)

    def chosen(of: np.ndarray, n_docs: np.ndarray) -> list[str]:
        excused = (_weights(of, tuple(n_docs.tolist()), 1) < MIN_WEIGHT) & (of[:, 1] >= 2)
        return [names[i] for i in np.flatnonzero(excused)]

    of_sizes = (sizes[0], sizes[1], sizes.sum(axis=0))
    return tuple(chosen(counts[:, i], n_docs) for i, n_docs in enumerate(of_sizes))


def _curve(halves: DataFrame, lexicons: list[Lexicon]) -> tuple[float, float, float]:
    """Logistic curve over what ``lexicons[half]`` finds in the texts of a half."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, matchers = Folder(), [Matcher(lexicon) for lexicon in lexicons]
        for batch in slices(batches):
            pairs = [
                matchers[half].measures(folder(text))
                for text, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.float64()),
                    pa.array([p[1] for p in pairs], pa.float64()),
                    batch.column("label").cast(pa.float64()),
                ],
                names=["weight", "density", "label"],
            )

    measured = halves.mapInArrow(run, "weight double, density double, label double")
    # At most as many rows as the sample; in order, so that sums come out the same.
    rows = measured.toPandas().to_numpy()
    rows = rows[np.lexsort(rows.T[::-1])]
    if len(rows) == 0 or len(np.unique(rows[:, 2])) < 2:
        return Lexicon({}).curve
    return tuple(logistic(rows[:, :2], rows[:, 2]).tolist())


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and coefficients by Newton's method."""
    x = np.column_stack((np.ones(len(features)), features))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (labels - p) - ridge * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (1 from a score of 0.5) and ``n_matches``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def task():
        folder, matcher = Folder(), Matcher(shared.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            folded = [folder(text) for text in batch.column(text_col).to_pylist()]
            scores = [matcher.score(text) for text in folded]
            return [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([matcher.weight(text)[1] for text in folded], pa.int64()),
            ]

        return work

    return add_columns(docs, "score double, predicted int, n_matches bigint", task)
