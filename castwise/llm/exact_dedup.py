"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full digest.

The first scan keeps only numbers: row id, byte length and the hash of the first
``PREFIX`` characters. Lengths held by one row, then (length, prefix hash) classes held by
one row, are settled there. A second scan digests whole texts, and only of rows whose class
still has company; texts are never shuffled. Survivors are recognised on the scan side by a
membership filter of fixed size, so rows it lets through by chance cost a digest and change nothing.

Null texts count as empty and are equal to one another. A null id sorts before every id.
Rows with the same id and text are one document: each gets the same verdict. Equal ids with
different texts are judged by text. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.llm.common import NO_ID, fold, given_id, maybe, membership, rows_of, without, written

PREFIX = 256


def _shape(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("_len"), F.xxhash64(F.left(text, F.lit(PREFIX))).alias("_prefix")]


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """``_id, _digest`` for every row; rows already known to be alone have a null digest.

    ``with_digest`` adds ``text_sha256``, the digest of every row, for callers who need it anyway.
    """
    rows = rows_of(docs, id_col, text_col)
    shapes = written(rows.select(*_shape(F.col("_text"))).groupBy("_len", "_prefix").agg(F.count("*").alias("_n")), "shapes")
    lengths = shapes.groupBy("_len").agg(F.sum("_n").alias("_rows")).filter("_rows > 1")
    classes = shapes.filter("_n > 1").join(lengths, "_len", "left_semi")
    kept = membership(classes, fold(8, F.col("_len"), F.col("_prefix")))
    shaped = rows.select("_id", "_text", *_shape(F.col("_text")))
    alive = maybe(kept, fold(8, F.col("_len"), F.col("_prefix")))
    full = F.sha2("_text", 256)
    if with_digest:
        marked = shaped.select("_id", alive.alias("_alive"), full.alias("text_sha256"))
        return marked.select("_id", F.when(F.col("_alive"), F.col("text_sha256")).alias("_digest"), "text_sha256")
    return shaped.select("_id", F.when(alive, full).alias("_digest"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept`` (and ``text_sha256``). The largest id of a group stays."""
    rows = written(refined(docs, id_col, text_col, with_digest), "digests")
    groups = (
        rows.filter("_digest is not null")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
        .filter("_size > 1")
    )
    # a row without a digest gets a key of its own, so that such rows do not meet in one partition
    key = F.coalesce("_digest", F.concat(F.lit("row "), F.col("_id").cast("string")))
    joined = rows.withColumn("_key", key).join(groups.withColumnRenamed("_digest", "_key"), "_key", "left")
    keep = F.coalesce("_keep", "_id")
    return joined.select(
        given_id().alias(id_col),
        F.when(keep != F.lit(NO_ID), keep).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (keep == F.col("_id")).alias("kept"),
        *(["text_sha256"] if with_digest else []),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    return without(docs, gone, id_col)
