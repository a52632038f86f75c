"""From raw documents to packed sequences: language, repeated lines, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import stages
from attesta.plans.staging import Staging, scratch

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", lambda spark, docs, sf_dir: stages.identify_language(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: stages.drop_repeated_lines(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: stages.drop_near_copies(docs)),
    ("substring_dedup", lambda spark, docs, sf_dir: stages.drop_repeated_passages(docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: stages.pack(docs)),
]

#: A recurrent network and byte-pair ids have no SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next one reads it.

    What a stage staged on its way goes once its result is written, and that result once the next one is.
    """
    staging, docs = Staging(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = staging.put(stage(spark, docs, sf_dir), name)
        if k:
            staging.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
