"""Keys, projections and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.functions.columns import sample_key
from castwise.schemas import STABLE


def with_sample_key(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_key", sample_key())


def bad_keys(df: DataFrame) -> DataFrame:
    """Rows whose key disagrees with their fields."""
    return df.filter(~F.col("sample_key").eqNullSafe(sample_key()))


def for_split(df: DataFrame, split: str) -> DataFrame:
    """One split; a partition filter when the table is partitioned by split."""
    return df.filter(F.col("split") == split)


def for_metric(df: DataFrame, metric: str) -> DataFrame:
    return df.filter(F.col("metric") == metric)


def restrict(df: DataFrame, experts: Sequence[str], configs: Sequence[str]) -> DataFrame:
    """Only the given experts and configs."""
    return df.filter(F.col("model_name").isin(list(experts)) & F.col("config_name").isin(list(configs)))


def restrict_check(df: DataFrame, experts: Sequence[str], configs: Sequence[str]) -> DataFrame:
    """Row count after :func:`restrict` against configs x experts x items."""
    kept = restrict(df, experts, configs).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("item_id").alias("item_count")
    )
    expected = F.col("item_count") * F.lit(len(experts) * len(configs))
    return kept.withColumn("expected_rows", expected).withColumn("passed", F.col("row_count") == F.col("expected_rows"))


def windows_of(labels: DataFrame) -> DataFrame:
    """Distinct windows named by label rows."""
    return labels.select(*STABLE).distinct()


def required_keys(labels: DataFrame, train: bool, score: bool) -> DataFrame:
    """Sample keys a run needs: vali when training, test when scoring."""
    wanted = (["vali"] if train else []) + (["test"] if score else [])
    return labels.filter(F.col("split").isin(wanted)).select("sample_key").distinct()


def dedup_samples(forecasts: DataFrame) -> DataFrame:
    """One row per sample out of one row per (sample, expert)."""
    return forecasts.select(*STABLE, "history_length", "pred_length").distinct()


def split_index(df: DataFrame, length: int | str, index: str = "linear_index") -> DataFrame:
    """Linear dataset index -> ``channel_id`` = i div len, ``window_index`` = i mod len."""
    n = F.col(length) if isinstance(length, str) else F.lit(length)
    i = F.col(index)
    return df.withColumn("channel_id", F.floor(i / n).cast("int")).withColumn("window_index", F.pmod(i, n).cast("int"))


def join_index(df: DataFrame, length: int | str, out: str = "linear_index") -> DataFrame:
    """Inverse of :func:`split_index`; a window outside ``[0, length)`` fails the job."""
    n = F.col(length) if isinstance(length, str) else F.lit(length)
    w = F.col("window_index")
    index = (F.col("channel_id") * n + w).cast("long")
    checked: Column = F.when((w >= 0) & (w < n), index).otherwise(
        F.raise_error(F.lit("window_index is out of range")).cast("long")
    )
    return df.withColumn(out, checked)


def shard_keys(features: DataFrame) -> DataFrame:
    """Sample keys of a shard with their row count; a count above 1 is a duplicate."""
    return features.groupBy("sample_key").agg(F.count(F.lit(1)).alias("key_rows"))


def duplicate_keys(features: DataFrame) -> DataFrame:
    return shard_keys(features).filter("key_rows > 1")
