"""Stages of the corpus pipeline.

Each takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with the
columns they came with, but for the last one, which returns their pieces.  Rows
without text or id pass, as no stage has anything against them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard, pieces, repeats, toxicity
from millrace.llm.common import stored, table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 on a lexicon learned from the labels."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    lexicon = toxicity.learn(
        written(toxicity.labelled_sample(docs, labels, "toxic"), "labelled")
    )
    scored = toxicity.score(docs, lexicon)
    return scored.filter("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id, once.

    Rows are linked by their own texts: rows that share an id but no text stay
    apart, equal rows are linked.  Rows without text or id are linked with nothing.
    """
    row = _unused("row", docs)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    known = numbered.filter("doc_id is not null")
    linked = jaccard.link(known.select(row, "text"), id_col=row).select(row, "component_id")
    least = F.min(F.struct("doc_id", row))[row].alias(row)
    first = known.select(row, "doc_id").join(linked, row).groupBy("component_id").agg(least)
    kept = known.join(first.select(row), row, "left_semi")
    return kept.unionByName(numbered.filter("doc_id is null")).select(*docs.columns)


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less what an earlier one says; nothing is left of some, and they go."""
    cut = repeats.remove_repeats(docs, as_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.withColumn("text", text).filter("n_removed = 0 or length(trim(text)) > 0")
    count = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", count.cast("bigint")).select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    marked = decontamination.decontaminate(docs, benchmark)
    return marked.filter(~F.col("contaminated")).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the remaining documents, decoded once to prove them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    read = pieces.encode(docs.select("doc_id", "text"), model, decoded="decoded")
    as_read = F.translate(F.coalesce("text", F.lit("")), pieces.BLANK, " ")
    return read.select(
        "doc_id", "n_tokens", "ids", (F.col("decoded") == as_read).alias("round_trip")
    )


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", not_in_benchmark),
    ("pieces", as_pieces),
]
