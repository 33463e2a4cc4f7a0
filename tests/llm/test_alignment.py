"""Alignment against two pointers in plain Python and against the libraries."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from millrace.llm import alignment, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason=f"{SF_DIR} is not there")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = alignment.byte_alphabet()

    def of_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def of_b(i):
        if b.is_byte(i):
            return bytes([int(b.id_to_piece(i)[3:5], 16)])
        return b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        """Tokens of A and of B as ``(id, bytes)``, none if the bytes differ."""
        if not text:
            return [], []
        sides = (
            [(i, of_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids],
            [(i, of_b(i)) for i in b.encode(text)],
        )
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
            return [], []
        return sides

    return tokens


def groups_of(a, b):
    """Groups of ids by walking along both, a token at a time."""
    out, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a):
            end_a += len(a[i][1])
            out[-1][0].append(a[i][0])
            i += 1
        else:
            end_b += len(b[j][1])
            out[-1][1].append(b[j][0])
            j += 1
        if end_a == end_b:
            out.append(([], []))
    return out[:-1]


def plain(texts, tokens):
    """The contract's columns, doc after doc; the digest as text."""
    rows = [groups_of(*tokens(text)) for text in texts]
    counts = Counter((g[0][-1], g[1][-1]) for groups in rows for g in groups)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for groups in rows:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        out.append(
            (
                sum(len(g[0]) for g in groups),
                sum(len(g[1]) for g in groups),
                len(groups),
                ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups),
                len(links),
                sum(counts[pair] == highest[pair[1]] for pair in links),
                sum(counts[pair] for pair in links),
            )
        )
    return out


def found(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    scored = alignment.score(alignment.align(df, *FILES), *FILES)
    names = ["n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    return [tuple(r) for r in scored.orderBy("doc_id").select(*names).collect()]


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "tion", "é", "ß", "日本", "😀", "\x00", "'s", "...", "$$$", "42"]
    parts += ["<|endoftext|>", "</s>", "<unk>", "<0x41>", "\x85", " ", " the", " of", "ly ", "́", "﻿"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(n)]


def test_odd_texts(spark, libraries):
    texts = odd_texts(400, 1) + [None, "", " ", "▁", "a▁b c", "x ▁y", "▁ ", "end ", " begin", "a  b", "a\n b", "a \nb"]
    assert found(spark, texts) == plain(texts, libraries)


def test_words_equal_whole_texts(libraries):
    """What is remembered by words is what the libraries give for texts."""
    encode = alignment.Tokenizers(*FILES)
    assert encode.by_words
    rng = random.Random(2)
    words = ["of", "the", "naïve", "don't", "x.\ny", "3.14", "(a)", "日本語", "<|endoftext|>", "—", "a​b", "zz" * 9]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(200)] + odd_texts(200, 3)
    for _ in range(2):
        (a, b), (n_a, n_b), good = encode(texts)
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        for i, text in enumerate(texts):
            expected = libraries(text)
            assert good[i] == bool(expected[0])
            assert a[ends_a[i] - n_a[i] : ends_a[i]].tolist() == [t for t, _ in expected[0]]
            assert b[ends_b[i] - n_b[i] : ends_b[i]].tolist() == [t for t, _ in expected[1]]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY_BYTES", 1000)
    encode = alignment.Tokenizers(*FILES)
    first = encode(["some words to keep", "and more"])
    encode([" ".join(f"w{i}" for i in range(500))])
    again = encode(["some words to keep", "and more"])
    assert len(encode._place) < 20 and first[0][0].tolist() == again[0][0].tolist()


def test_long_texts_are_lanes(spark, libraries):
    rng = random.Random(4)
    words = ["of", "the", "tion", "unhappily", "日本", "....", "1234567", "x"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 190, 192, 193, 5_000, 40)] + ["ab" * 4_000, "=" * 3_000]
    assert found(spark, texts) == plain(texts, libraries)


def test_lockstep_on_random_ends():
    rng = np.random.default_rng(5)
    a_all, b_all, first, last, expected, base = [], [], [], [], [], 0
    for _ in range(60):
        size = int(rng.integers(1, 3_000))
        a = np.unique(np.append(rng.integers(1, size + 1, size // 3), size)) + base
        b = np.unique(np.append(rng.integers(1, size + 1, size // 2), size)) + base
        first.append(len(a_all))
        a_all += a.tolist()
        b_all += b.tolist()
        last.append(len(a_all))
        expected += sorted(set(a.tolist()) & set(b.tolist()))
        base += size
    a_all, b_all = np.array(a_all), np.array(b_all)
    link_a, link_b = alignment.lockstep(a_all, b_all, np.array(first), np.array(last))
    assert a_all[link_a].tolist() == b_all[link_b].tolist() == expected


def test_edges(spark, edge_docs, no_docs, libraries):
    scored = alignment.score(alignment.align(edge_docs, *FILES), *FILES)
    assert scored.count() == edge_docs.count() and "kept" in scored.columns
    rows = {r["doc_id"]: r for r in scored.collect()}
    for none in (1, 2, 7):  # no text, an empty one, one with the blank sign
        row = rows[none]
        assert (row["n_a"], row["n_b"], row["n_groups"], row["groups"], row["links"]) == (0, 0, 0, "", [])
        assert (row["n_links"], row["n_best"], row["count_sum"]) == (0, 0, 0)
    assert rows[3]["groups"] == rows[4]["groups"] and rows[3]["n_links"] > 40_000
    assert scored.filter("doc_id = 6").select("groups").distinct().count() == 1
    empty = alignment.score(alignment.align(no_docs, *FILES), *FILES)
    assert empty.count() == 0 and empty.columns == scored.columns


def test_pairs_are_bounded_by_the_vocabularies(spark):
    assert 100_000 < alignment.most_pairs(*FILES) < 1_000_000


@needs_data
def test_query_over_the_table(spark, libraries):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    expected = plain([r["text"] for r in docs], libraries)
    got = queries.op13_alignment(spark, SF_DIR).orderBy("doc_id").collect()
    digests = spark.createDataFrame([(i, e[3]) for i, e in enumerate(expected)], "i bigint, g string")
    digest = F.when(F.col("g") == "", "").otherwise(F.sha2("g", 256))
    digests = [r[0] for r in digests.orderBy("i").select(digest).collect()]
    for row, doc, e, d in zip(got, docs, expected, digests, strict=True):
        assert row["doc_id"] == doc["doc_id"] and row["groups_sha256"] == d
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["n_best"], row["count_sum"]) == (
            *e[:3],
            *e[4:],
        )
