"""Cleaning and mixing of the documents table: five stages, each written as Parquet and read back.

Null texts count as empty: no stage rejects a document for having no words, and all documents without words pass on
(a near-copy group needs words). A null id is an id of its own. Rows of one id share the verdicts of toxicity, near copies and
decontamination; ties stay with the earlier line and the smallest id. Empty tables give empty tables, and further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from castwise.llm.common import table, without, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; without labels of both classes none does, unless all labels are toxic."""
    scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scores.filter("predicted = 1").select(F.col("doc_id").alias("_gone")), "doc_id")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts. A document that loses all its words goes; one that had none stays."""
    out = line_dedup.drop_repeated_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items without words are never held."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``mix_rate`` and ``mix_copies``; documents with rate 0 go."""
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("mixing", mixed),
]
# Training of classifiers and projected gradients are not SQL; tests compare stages with plain Python forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
