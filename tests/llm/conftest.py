from __future__ import annotations

import os
import random
import sys

import pytest

pytest.importorskip("millrace.llm")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EXTRA = "doc_id bigint, text string, lang string, score double, n_bytes string, kept int, key string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """NULLs, empty and very long texts, repeated rows, columns with names of results."""
    long = "wort " * 40_000 + "ende"
    rows = [
        (1, None, None, None, None, None, None),
        (2, "", "en", 0.5, "x", 1, "k"),
        (3, long, "de", None, None, None, None),
        (4, long, None, 0.1, None, None, None),
        (5, " \n\t ", "en", None, None, None, None),
        (6, "a short text", "en", None, None, None, None),
        (6, "a short text", "en", None, None, None, None),
        (None, "no id at all", "en", None, None, None, None),
        (7, "\x00 \U0001f600 ßé ▁ x  y", "fr", None, None, None, None),
    ]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages and periodic stretches."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgß", k=rng.randint(1, 7))) for _ in range(120)]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    base, passage = prose(150), prose(30)
    docs = [(0, base), (1, base), (2, prose(200) + " " + passage), (3, passage + " " + prose(90))]
    for i in range(4, 44):
        words = base.split(" ")
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, " ".join(words[: rng.randint(100, 150)])))
    docs += [(44, "ab" * 300), (45, "x" + "ab" * 280), (46, "ab ab " * 90), (47, "word"), (48, "WORD"), (49, "w x y z")]
    docs += [(50, "w x y z"), (51, None), (52, ""), (53, "ÄÖ " * 60), (54, "ÄÖ " * 59 + "Ü")]
    docs += [(i, prose(rng.randint(1, 60))) for i in range(55, 75)]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)
