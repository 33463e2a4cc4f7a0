"""Text quality by learning from trusted positives and unlabelled text.

A text is described by shares: of letters, capitals, digits, signs, repeated
words and lines, and the like.  Each is spread over hat functions at fixed
knots, so that a linear score can bend.  The score minimises the non-negative
unbiased risk of positive-unlabelled learning,

    pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)),

with the squared loss, for which both risks follow from first and second
moments.  Those are summed over all texts where the texts are; no text and no
gradient passes through the driver, whatever the size of the corpus.

NULL and empty texts are described like any other and get a score.  Rows that
occur twice count twice in the moments and are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_columns, slices, text_bytes

KNOTS = 9
RIDGE = 1e-3
MEASURES = 24
WIDTH = MEASURES * KNOTS + 1

# Byte classes: letter or part of one, capital, digit, sign, space, line end.
_KIND = np.full(256, 3, dtype=np.int64)
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_SENTENCE_END = (b".", b"!", b"?")
_STRIP = b".,;:!?\"'()[]"


def _damped(share: float) -> float:
    """Small shares spread out over 0 to 1."""
    return float(np.log1p(255 * min(1.0, max(0.0, share))) / np.log(256))


def measure(text: bytes) -> list[float]:
    """Shares that describe a text, each from 0 to 1."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = max(1, len(data))
    small, capital, digit, sign, space, line_end = np.bincount(_KIND[data], minlength=6) / n
    words = text.split()
    n_words = max(1, len(words))
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_lines = max(1, len(lines))
    # A word that follows itself, and a word that was there two words earlier.
    again = sum(a == b for a, b in zip(words, words[1:])) / n_words
    again_2 = sum(a == b for a, b in zip(words, words[2:])) / n_words
    ends = [w[-1:] for w in words]
    by_end = Counter(ends)
    full_stops = sum(by_end[e] for e in _SENTENCE_END) / n_words
    odd_ends = sum(c for e, c in by_end.items() if not (e.isalnum() or e >= b"\x80")) / n_words
    bare = sum(c for w, c in counts.items() if not any(b >= 128 or 97 <= (b | 32) <= 122 for b in w)) / n_words
    runs = sum(c for w, c in counts.items() if len(w) > 2 and w[-1] == w[-2] and not w[-1:].isalnum()) / n_words
    shouted = sum(c for w, c in counts.items() if len(w.strip(_STRIP)) > 1 and w.isupper()) / n_words
    common = sum(c for _, c in counts.most_common(10)) / n_words
    longest = max(map(len, words), default=0)
    line_share = 1 - len(set(lines)) / n_lines
    signs = Counter(text.translate(None, _NOT_SIGNS))
    top_sign = max(signs.values(), default=0) / n
    return [
        _damped(small) ** 4,
        _damped(capital),
        _damped(digit),
        _damped(sign),
        _damped(space),
        _damped(line_end * 4),
        min(1.0, len(text) / n_words / 20),
        min(1.0, np.log1p(n_words) / 10),
        len(counts) / n_words,
        counts.most_common(1)[0][1] / n_words if counts else 0.0,
        common,
        _damped(again),
        _damped(again_2),
        _damped(full_stops),
        _damped(odd_ends),
        _damped(bare),
        _damped(runs),
        _damped(shouted),
        min(1.0, np.log1p(longest) / 8),
        line_share,
        _damped(top_sign),
        _damped(sum(signs[b] for b in b"|{}<>[]\\/=_#$%&*@~^") / n),
        min(1.0, np.log1p(n_words / n_lines) / 8),
        _damped(max((c for w, c in counts.items() if len(w) > 5), default=0) / n_words),
    ]


_NOT_SIGNS = bytes(b for b in range(256) if _KIND[b] != 3)


def basis(measures: np.ndarray) -> np.ndarray:
    """Hat functions of every measure, and a constant."""
    place = np.clip(measures, 0, 1) * (KNOTS - 1)
    hats = np.maximum(0, 1 - np.abs(place[:, :, None] - np.arange(KNOTS)))
    return np.column_stack((hats.reshape(len(measures), -1), np.ones(len(measures))))


def describe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``measures``, the shares of each text as 32-bit floats."""

    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [
                np.array(measure(text), dtype=np.float32).tobytes()
                for text in text_bytes(batch.column(text_col))
            ]
            return [pa.array(rows, pa.binary())]

        return work

    return add_columns(docs, "measures binary", task)


def described(column: pa.Array) -> np.ndarray:
    """The basis of each row of ``measures``."""
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32)
    return basis(rows.astype(np.float64).reshape(len(column), MEASURES))


@dataclass(frozen=True)
class Moments:
    """Number of texts, mean of the basis, mean of its products."""

    n: float
    first: np.ndarray
    second: np.ndarray


def moments(docs: DataFrame, positive_col: str) -> tuple[Moments, Moments]:
    """Moments of all texts, and of those where ``positive_col`` is true.

    Each task sums up its own texts; sums of a fixed size move on and are
    added in two steps.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for batch in slices(batches):
            x = described(batch.column("measures"))
            chosen = batch.column("positive").fill_null(False).to_numpy(zero_copy_only=False)
            for group, rows in enumerate((x, x[chosen])):
                sums[group] += np.concatenate(([len(rows)], rows.sum(0), (rows.T @ rows).ravel()))
        yield _sum_batch(sums)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for batch in batches:
            for group, row in zip(batch.column("positive").to_pylist(), batch.column("sums").to_pylist()):
                sums[group] += np.frombuffer(row)
        yield _sum_batch(sums)

    ddl = "positive int, sums binary"
    rows = docs.select("measures", F.col(positive_col).alias("positive"))
    per_task = rows.mapInArrow(run, ddl)
    spread = F.pmod(F.spark_partition_id(), F.lit(16))
    combined = per_task.repartition(16, spread).mapInArrow(add, ddl).collect()
    total = [np.zeros(1 + WIDTH + WIDTH * WIDTH), np.zeros(1 + WIDTH + WIDTH * WIDTH)]
    for row in combined:
        total[row["positive"]] += np.frombuffer(row["sums"])
    return tuple(_mean(row) for row in total)


def _sum_batch(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int32()), pa.array([row.tobytes() for row in sums], pa.binary())],
        names=["positive", "sums"],
    )


def _mean(row: np.ndarray) -> Moments:
    n = max(row[0], 1.0)
    return Moments(row[0], row[1 : 1 + WIDTH] / n, row[1 + WIDTH :].reshape(WIDTH, WIDTH) / n)


# Plain array operations below: threaded linear algebra can stall for good in a
# process that also drives a JVM, and these matrices are small.


def _times(matrix: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (matrix * w).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination; the matrix is positive definite."""
    left, right = matrix.copy(), np.eye(len(matrix))
    for i in range(len(matrix)):
        pivot = left[i, i]
        left[i], right[i] = left[i] / pivot, right[i] / pivot
        factor = left[:, i].copy()
        factor[i] = 0
        left -= np.outer(factor, left[i])
        right -= np.outer(factor, right[i])
    return right


def risks(w: np.ndarray, prior: float, of_all: Moments, positives: Moments) -> tuple[float, float]:
    """``pi R+(positives)`` and ``R-(all) - pi R-(positives)``."""
    mean, mean_all = (w * positives.first).sum(), (w * of_all.first).sum()
    square = (w * _times(positives.second, w)).sum()
    square_all = (w * _times(of_all.second, w)).sum()
    plus, minus = (1 - 2 * mean + square) / 4, (1 + 2 * mean + square) / 4
    return prior * plus, (1 + 2 * mean_all + square_all) / 4 - prior * minus


def fit(
    prior: float, of_all: Moments, positives: Moments, ridge: float = RIDGE, steps: int = 400
) -> np.ndarray:
    """Weights that minimise the non-negative risk, by preconditioned descent.

    While the part that estimates the risk on negatives is below zero, which
    no true risk can be, a step leads back up along it.
    """
    scale = _inverse(of_all.second + ridge * np.eye(WIDTH))
    w, best, least = np.zeros(WIDTH), np.zeros(WIDTH), np.inf
    for step in range(steps):
        plus, negative = risks(w, prior, of_all, positives)
        value = plus + max(0.0, negative) + ridge * (w * w).sum() / 4
        if value < least:
            best, least = w.copy(), value
        on_positives = _times(positives.second, w)
        to_positives = prior * (on_positives - positives.first) / 2
        to_negatives = (
            of_all.first + _times(of_all.second, w) - prior * (positives.first + on_positives)
        ) / 2
        if negative >= 0:
            slope = to_positives + to_negatives + ridge * w / 2
        else:
            slope = -to_negatives
        w = w - (1.0 if step < steps // 2 else 0.2) * _times(scale, slope)
    return best


def learn(docs: DataFrame, label_col: str = "label") -> np.ndarray:
    """Weights from described texts whose ``label_col`` is 1 (trusted), 0 or NULL (not used).

    The class prior is the share of ones among the labels that are known.
    Without any positive text the weights are zero.
    """
    known = docs.agg(F.avg(F.col(label_col).cast("double")).alias("prior")).first()
    positive = docs.withColumn("_positive", F.coalesce(F.col(label_col) == 1, F.lit(False)))
    of_all, positives = moments(positive, "_positive")
    if not positives.n:
        return np.zeros(WIDTH)
    return fit(min(0.99, max(0.01, known["prior"])), of_all, positives)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Add to described texts ``score`` (0 to 1; the loss makes it a probability) and ``predicted``."""

    def task():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            scores = described(batch.column("measures")) @ weights
            scores = np.clip((scores + 1) / 2, 0.0, 1.0)
            return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

        return work

    return add_columns(docs, "score double, predicted int", task)
