"""Quality rules by compression against plain counts and made-up texts."""

from __future__ import annotations

import base64
import os
import random
import re

import pytest
import zstandard
from millrace.llm import bands, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason=f"{SF_DIR} is not there")


def plain(text):
    """The base rules, character by character."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, again, len(hit), failed


def verdict(text):
    """The bands, spelled out."""

    def inside(data, limits):
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data)
        band = None
        for limit in limits:
            if len(data) >= limit.size:
                band = limit
        return band is None or band.low <= ratio <= band.high

    data = text.encode()
    cut = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    if len(cut) > 1 and len(cut[-1]) < 2048:
        last = cut.pop()
        cut[-1] += last
    bad = sum(len(c) for c in cut if not inside(c, bands.CHUNK_BANDS))
    return inside(data, bands.DOCUMENT_BANDS) and 4 * bad < len(data)


def prose(n, seed=1):
    rng = random.Random(seed)
    parts = ["the", "an", "in", "tion", "er", "th", "st", "re", "on", "wh", "le", "ou", "is", "ly", "é", "k"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def random_text(n, seed=2):
    return base64.b64encode(random.Random(seed).randbytes(n)).decode()


def spaced(text, every=7):
    return " ".join(text[i : i + every] for i in range(0, len(text), every))


TEXTS = {
    "prose": (prose(400), True),
    "long prose": (prose(30_000), True),
    "short prose": (prose(60), True),
    "too short": (prose(49), False),
    "one word many times": ("word " * 300, False),
    "encoded file": (spaced(random_text(6_000)), False),
    "prose, then an encoded file": (prose(1_500) + " " + random_text(9_000), False),
    "prose with a key": (prose(400) + " " + random_text(48), True),
    # Each line differs in a number, which escapes rules on repeated words.
    "one line with a counter": (" ".join(f"row{i}value{i}of{i}the{i}table" for i in range(2_000)), False),
    "prose and a tail of one character": (prose(300) + " " + "x" * 20_000, False),
}


@pytest.mark.parametrize("name", TEXTS)
def test_made_up_texts(spark, name):
    text, kept = TEXTS[name]
    row = bands.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["kept"] == kept
    assert row["kept"] == (not row["base_failed"] and verdict(text))
    if len(text) < 20_000:
        assert tuple(row)[2:8] == plain(text)


def test_base_rules_equal_plain_counts(spark):
    rng = random.Random(3)
    parts = ["a", "b", "ab ", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", "é", "日", "😀", "#", "|", "<>", "x y z "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 250))) for _ in range(300)]
    texts += ["a b c a b c", "a b c d a b c", "a a a a", "a a a", "\n\n\n", "x\nx\n x\nx"]
    df = bands.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for row in df.collect():
        assert tuple(row)[2:8] == plain(texts[row["doc_id"]])


def test_edges(edge_docs, no_docs):
    judged = bands.judge(edge_docs)
    rows = {r["doc_id"]: r for r in judged.collect()}
    assert judged.count() == edge_docs.count()
    assert "score" in judged.columns and rows[2]["score"] == 0.5  # other columns stay
    for empty in (1, 2, 5):
        assert (rows[empty]["n_words"], rows[empty]["base_failed"], rows[empty]["kept"]) == (0, True, False)
    assert rows[1]["ratio"] is None and rows[3]["n_repeat_words"] == 39_999 + 1
    assert rows[3]["kept"] is False and rows[None]["n_words"] == 4
    assert bands.judge(no_docs).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 100, 2047, 2048, 4096, 6143, 6144, 9000):
        data = os.urandom(n)
        cut = bands.chunks(data)
        assert b"".join(cut) == data
        assert all(len(c) == 4096 for c in cut[:-1])


@needs_data
def test_query_over_the_table(spark):
    rows = queries.op12_quality_rules(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").filter("quality = 1").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        if len(text) < 4_000:
            assert tuple(row)[1:7] == plain(text)
            assert row["kept"] == (not row["base_failed"] and verdict(text))
    assert all(r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"])
