"""Helpers shared by the text operators."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.session import written  # noqa: F401  (operators take it from here)

SPACE = r"[\x20\x09-\x0D]+"
NO_ID = -(2**63)
FILTER_WORDS = 1 << 14  # longs in a membership filter: 1,048,576 bits, 128 KiB at every input size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``_id`` (null ids become the smallest long) and ``_text`` (null texts become empty)."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )


def given_id(name: str = "_id") -> Column:
    """The id as it was given: the stand-in for null becomes null again."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def fold(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def membership(keys: DataFrame, hashed: Column) -> Column:
    """A scalar subquery: bits of all ``hashed`` values in ``keys``, as an array of longs of fixed size.

    Test with ``maybe``. It lets everything through that is in ``keys`` (and some that is
    not), so a join behind it stays exact while most rows never reach the shuffle.
    """
    word = F.pmod(F.shiftright(hashed, 6), F.lit(FILTER_WORDS)).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(_hash, 64) as int))")
    zeros = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = keys.select(hashed.alias("_hash"), word.alias("_word")).select("_word", bit.alias("_bits")).union(zeros)
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return words.agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_all")).select("_all._bits").scalar()


def maybe(words: Column, hashed: Column) -> Column:
    """False only for values that are surely not in the filter."""
    word = F.get(words, F.pmod(F.shiftright(hashed, 6), F.lit(FILTER_WORDS)).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed, F.lit(64)).cast("int"))) != 0


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``gone`` (column ``_gone``); null ids match null ids.

    Rows that a membership filter clears are passed on where they are read; only the rest meets ``gone`` in a join.
    """
    gone = written(gone.select(F.coalesce(F.col("_gone").cast("long"), F.lit(NO_ID)).alias("_gone")).distinct(), "gone")
    mine = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    listed = maybe(membership(gone, F.xxhash64("_gone")), F.xxhash64(mine))
    return docs.filter(~listed).unionByName(docs.filter(listed).join(gone, mine == F.col("_gone"), "left_anti"))


def sliced(batches, column: str, most: int = 1 << 22):
    """Arrow batches cut so that ``column`` has about ``most`` bytes in each, or one row if that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
