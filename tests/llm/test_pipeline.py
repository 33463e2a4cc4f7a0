"""The pipeline against its stages done plainly, on a small folder of tables."""

from __future__ import annotations

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from millrace.llm import pieces
from millrace.llm.common import BATCH_BYTES, pass_through
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    leak = "question number nine asks which of the nine answers is the right one"
    bad = [(1000 + i, f"some words {i} about nothing w0rthless{i % 2} SCUM{'!' * i} and {i} more of them") for i in range(60)]
    docs = [*corpus, *bad, (2000, f"intro {leak} outro")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= 1000 and i < 2000)) for i, _ in docs]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, leak


def test_pipeline(spark, folder):
    path, docs, leak = folder
    clean = [(i, t) for i, t in docs if not 1000 <= i < 2000]
    first = {i: c for i, _, c in brute.linked(clean)}
    alone = [(i, t) for i, t in clean if first[i] == i]
    cut = {i: (n, kept.decode("utf-8", "ignore")) for i, _, n, _, kept in brute.repeats(alone)}
    left = [(i, cut[i][1] if cut[i][0] else t) for i, t in alone if not cut[i][0] or cut[i][1].strip(" ")]
    marked = {i: bad for i, *_, bad in brute.contamination(left, [(1, leak)])}
    ours = pieces.compiled(public_tokenizers.path("piece_bpe_32k.model"))
    expected = {i: np.frombuffer(ours.encode(t), "<i4").tolist() for i, t in left if not marked[i]}
    found = corpus_pipeline.run(spark, path)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == expected
    assert 2000 not in expected and found.filter("not round_trip").count() == 0


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, folder):
    path, _, _ = folder
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = one.replace("a39", "x")
    rows = [(5, one, 1), (9, one, 2), (9, other, 3), (9, other, 4), (3, near, 5), (None, one, 6), (None, one, 7)]
    rows += [(8, None, 8), (8, None, 9), (8, "", 10), (7, "word " * 60_000, 11), (6, "word " * 60_000, 12)]
    schema = "doc_id bigint, text string, component_id bigint"
    docs = spark.createDataFrame(rows, schema).withColumn("row", F.lit("r")).withColumn("n_shingles", F.lit(1))
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    out = stage(spark, docs, path)
    assert out.columns == docs.columns
    kept = sorted(r["component_id"] for r in out.collect())
    # Of the first group id 3 stays, of the second one of two equal rows.
    assert kept in ([x, 5, 6, 7, 8, 9, 10, 12] for x in (3, 4))


@pytest.mark.parametrize("name", ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "pieces"])
def test_stages_take_nulls_repeats_and_clashing_names(spark, folder, name):
    path, _, _ = folder
    long = "wort " * 40_000 + "ende"
    rows = [(1, None), (2, ""), (3, long), (4, " \n\t "), (5, "a short text"), (5, "a short text"), (None, "no id at all")]
    clash = ["component_id", "predicted", "kept", "contaminated", "row", "_row", "score", "n_items"]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for column in clash:
        docs = docs.withColumn(column, F.lit("own"))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, path)
    found = out.collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5, None}
    if name != "pieces":
        assert out.columns == docs.columns
        assert len(found) == (6 if name == "ngram_jaccard" else 7)


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    apart = spark.newSession()
    texts = apart.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 2000).alias("text"))
    most = max(r["n"] for r in pass_through(texts, run, "n bigint").collect())
    assert most < 2 * BATCH_BYTES
    # A bound that the session has already stays.
    apart.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 18))
    assert max(r["n"] for r in pass_through(texts, run, "n bigint").collect()) < 1 << 19
