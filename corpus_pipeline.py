"""From raw documents to a cleaned, tokenised corpus, one operator per stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  What it returns is
written as Parquet and read again as ``docs`` of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import written
from millrace.llm.stages import STAGES as _STAGES

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = list(_STAGES)

# Several stages have no SQL form; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position + 1 < len(STAGES):
            docs = written(docs, f"stage-{position + 1}-{name}")
    return docs
