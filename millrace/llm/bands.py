"""Quality rules by compression: text must compress like text.

The ratio of zstandard's output to the input is taken over the whole document
and over chunks of ``CHUNK`` bytes.  Repeated text compresses far better than
prose and random strings (keys, encoded files) far worse, so a document is
kept if its ratio lies in the band for its length, and if chunks outside the band
for their length hold less than ``BAD_SHARE`` of its bytes.  Short texts have wider
and higher bands, as a compressor has little to refer to and a header to write.
Texts of fewer bytes than the first band starts at have no verdict by ratio.

Before that come base rules on words (runs without ASCII white space): a
document fails with fewer than ``LEAST_WORDS`` words, or if more than half of
its words lie in windows of three words that occur twice or more in it.

NULL and empty texts have no words and fail.  Documents are judged on their
own: ties, repeated rows and the size of the table play no part, and empty tables give no rows.
Texts are processed whole, a few megabytes at a time in a task; a longer
text is a slice of its own, and needs memory in proportion to its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from millrace.llm.common import add_columns, text_bytes

LEVEL = 3
CHUNK = 4096
BAD_SHARE = 0.25
LEAST_WORDS = 50
WINDOW = 3
# Of 100 words, so many may lie in repeated windows.
MOST_REPEATED = 50

_BLANKS = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
# Bytes that continue a character.
_INNER = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Band:
    """From ``size`` bytes on, ratios from ``low`` to ``high`` pass."""

    size: int
    low: float
    high: float


# Prose in any script lies well inside: about 0.65 at 300 bytes and 0.40 at 30,000 for Latin
# letters.  A text said three times over falls to a third of that.
# Base64 stays near 0.76 and hexadecimal digits near 0.57 at any length.
DOCUMENT_BANDS = (
    Band(128, 0.30, 0.95),
    Band(512, 0.27, 0.85),
    Band(2_048, 0.24, 0.72),
    Band(8_192, 0.21, 0.66),
    Band(32_768, 0.18, 0.62),
    Band(262_144, 0.15, 0.60),
)
CHUNK_BANDS = (Band(128, 0.22, 0.98), Band(512, 0.20, 0.90), Band(2_048, 0.17, 0.74))

_ADDED = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, least_chunk double, greatest_chunk double, "
    "n_bad_bytes bigint, kept boolean"
)


def within(size: int, ratio: float, bands: Sequence[Band]) -> bool:
    """Whether the band for a length, the last that starts at or before it, holds the ratio."""
    fitting = [band for band in bands if band.size <= size]
    return not fitting or fitting[-1].low <= ratio <= fitting[-1].high


def chunks(text: bytes, size: int = CHUNK) -> list[bytes]:
    """Stretches of ``size`` bytes; a last one shorter than half of that joins the one before."""
    starts = list(range(0, len(text), size))
    if len(starts) > 1 and len(text) - starts[-1] < size // 2:
        starts.pop()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*[words[i:] for i in range(window)]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside, end = 0, 0
    for at, one in enumerate(windows):
        if counts[one] > 1:
            inside += at + window - max(end, at)
            end = at + window
    return inside


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


class _Judge:
    """Everything about one text after the other; made once per task."""

    def __init__(self, document_bands: Sequence[Band], chunk_bands: Sequence[Band], chunk: int, level: int):
        self._compressor = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self._document_bands, self._chunk_bands, self._chunk = document_bands, chunk_bands, chunk

    def _ratio(self, data: bytes) -> float:
        return len(self._compressor.compress(data)) / len(data)

    def __call__(self, text: bytes) -> tuple:
        words = text.split()
        n_repeated = repeated_words(words)
        failed = len(words) < LEAST_WORDS or 100 * n_repeated > MOST_REPEATED * len(words)
        ratio = least = greatest = None
        bad = 0
        if text:
            ratio = self._ratio(text)
            parts = chunks(text, self._chunk)
            ratios = [ratio] if len(parts) == 1 else list(map(self._ratio, parts))
            least, greatest = min(ratios), max(ratios)
            bad = sum(len(p) for p, r in zip(parts, ratios) if not within(len(p), r, self._chunk_bands))
        kept = (
            not failed
            and within(len(text), ratio, self._document_bands)
            and bad < BAD_SHARE * len(text)
        )
        return (
            len(words),
            len(text.translate(None, _BLANKS + _INNER)),
            len(text) - len(text.translate(None, _SYMBOLS)),
            repeated_lines(text),
            n_repeated,
            failed,
            ratio,
            least,
            greatest,
            bad,
            kept,
        )


def judge(
    docs: DataFrame,
    text_col: str = "text",
    document_bands: Sequence[Band] = DOCUMENT_BANDS,
    chunk_bands: Sequence[Band] = CHUNK_BANDS,
    chunk: int = CHUNK,
    level: int = LEVEL,
) -> DataFrame:
    """Add counts, ratios and verdicts to every row.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``
    are the base rules; ``ratio`` is of the whole text, ``least_chunk`` and
    ``greatest_chunk`` of its chunks (NULL where there is no text);
    ``n_bad_bytes`` lie in chunks outside their band; ``kept`` is the verdict.
    """
    at = docs.columns.index(text_col)

    def task():
        one = _Judge(document_bands, chunk_bands, chunk, level)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = list(zip(*map(one, text_bytes(batch.column(at)))))
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.int64(), pa.bool_()]
            return [pa.array(values, kind) for values, kind in zip(found, kinds)]

        return work

    return add_columns(docs, _ADDED, task, bounded=text_col)
