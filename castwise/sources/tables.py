"""Parquet scans and sinks of the library's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.schemas import FORECASTS_SCHEMA, labels_schema


def read_forecasts(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Forecast table scan; only ``cols`` are read from the files."""
    df = spark.read.schema(FORECASTS_SCHEMA).parquet(path)
    return df.select(*cols) if cols else df


def read_labels(
    spark: SparkSession, path: str, experts: Sequence[str], metric: str, keys: DataFrame | None = None
) -> DataFrame:
    """Label rows of one metric (pushed to the scan), optionally only of the given sample keys."""
    df = spark.read.schema(labels_schema(experts)).parquet(path).filter(F.col("metric") == metric)
    return df if keys is None else df.join(keys.select("sample_key"), "sample_key", "left_semi")


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """All shards of a feature table as one table, each row with the file it came from."""
    return spark.read.parquet(*paths).withColumn("source_file", F.col("_metadata.file_name"))


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", files: int | None = None, spread: str = "sample_key"
) -> None:
    """zstd Parquet sink, partitioned so that config and split filters prune folders.

    ``files`` bounds the files of a folder: rows are dealt by folder and, so that a folder with most rows is
    written by as many tasks, by a hash of ``spread`` (another one than that of the shards). Without it every task may leave a file in every folder.
    """
    if files:
        dealt = [F.col(c) for c in partition_by] + ([F.pmod(F.xxhash64(F.lit("file"), spread), F.lit(files))] if files > 1 else [])
        df = df.repartition(*dealt) if dealt else df.repartition(files)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_groups(df: DataFrame, path: str, group: Sequence[str], files: int = 1) -> None:
    """Replaces exactly the folders of a stored table that ``df`` has rows of; all others keep their files.

    ``group`` are the columns the table is partitioned by, in their order. ``df`` must not read the table it replaces.
    """
    dealt = [F.col(c) for c in group] + ([F.pmod(F.xxhash64("sample_key"), F.lit(files))] if files > 1 else [])
    writer = df.repartition(*dealt).write.mode("overwrite").option("compression", "zstd")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*group).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Sink bucketed and sorted on the join keys: later joins and groupings on them need no shuffle.

    Rows are dealt to the buckets before they are written, so there is one file a bucket.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )


def write_sharded(df: DataFrame, path: str, shards: int, key: str = "sample_key", files: int = 1) -> DataFrame:
    """Write ``shards`` folders of ``files`` files each by key hash; returns the shard index (shard, rows, path).

    A file is written by one task: take as many as keep its rows within one. The hash spreads keys evenly, and a sample is one row.
    """
    spark = df.sparkSession
    sharded = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    write_table(sharded, path, ["shard"], files=files, spread=key)
    written = spark.read.parquet(path)
    return shard_index(written, shards, path)


def shard_index(sharded: DataFrame, shards: int, path: str) -> DataFrame:
    """One row per shard number, empty shards included."""
    spark = sharded.sparkSession
    counts = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("row_count"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(counts, "shard", "left").select(
        "shard",
        F.lit(shards).alias("shard_count"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.concat(F.lit(f"{path}/shard="), F.col("shard").cast("string")).alias("path"),
    )
