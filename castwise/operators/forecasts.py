"""Forecast records: assembly and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise.functions.columns import abs_error_mean, square_error_mean
from castwise.schemas import CACHE_VERSION, FORECASTS_SCHEMA, SPLITS


def score_forecasts(df: DataFrame) -> DataFrame:
    """Window ``mae`` and ``mse`` from ``y_true`` and ``y_pred``; unequal length fails the job."""
    return df.withColumn("mae", abs_error_mean(F.col("y_true"), F.col("y_pred"))).withColumn(
        "mse", square_error_mean(F.col("y_true"), F.col("y_pred"))
    )


def make_forecasts(
    predictions: DataFrame,
    expert_version: str = "unversioned",
    checkpoint_selection: str = "not_applicable",
    cache_version: str = CACHE_VERSION,
    scored: bool = False,
) -> DataFrame:
    """Forecast records from windows carrying ``model_name`` and ``y_pred``.

    A split outside vali/test fails the job. ``scored``: the windows carry ``mae`` and ``mse`` already.
    """
    checked = F.when(F.col("split").isin(SPLITS), F.col("split")).otherwise(
        F.raise_error(F.concat(F.lit("unknown split "), F.coalesce(F.col("split"), F.lit("NULL")))).cast("string")
    )
    full = (
        (predictions if scored else score_forecasts(predictions))
        .withColumn("split", checked)
        .withColumn("cache_version", F.lit(cache_version))
        .withColumn("expert_version", F.lit(expert_version))
        .withColumn("checkpoint_selection", F.lit(checkpoint_selection))
    )
    return full.select(*FORECASTS_SCHEMA.names)


def recheck_metrics(forecasts: DataFrame) -> DataFrame:
    """Largest absolute difference between stored and recomputed errors, per expert."""
    again = forecasts.select(
        "model_name",
        F.abs(F.col("mae") - abs_error_mean(F.col("y_true"), F.col("y_pred"))).alias("_a"),
        F.abs(F.col("mse") - square_error_mean(F.col("y_true"), F.col("y_pred"))).alias("_s"),
    )
    return again.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("_a").alias("max_mae_diff"), F.max("_s").alias("max_mse_diff")
    )
