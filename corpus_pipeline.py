"""The corpus pipeline: five stages, each one operator over all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``.  Rows with
nulls, empty texts, repeated rows and extra columns pass by the rules of the
operators; all stages but the last return the columns of ``docs`` unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstats.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from tripstats.llm.common import cut, pick, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from all labelled documents given."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (up to whitespace), the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark text."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return pick(docs, found, F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left with its copies in the mix: ``doc_id, source, size, source_size, target, rate,
    copies, taken`` (no copies: the mix leaves it out)."""
    return mixing.mix(docs)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_duplicates),
          ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_decontamination),
          ("mixing sources", source_mix)]

#: No SQL: the classifier, the signatures and the mix have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, "stage-" + name.replace(" ", "-"))
    return docs
