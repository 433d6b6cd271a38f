"""Seventeen features of the history window; never reads the future or any error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.functions.columns import finite_or_zero, is_finite, sample_key
from castwise.functions.spectral import (
    SPECTRAL,
    adf_at_lags,
    spectral_features_of,
    stationarity_of,
    time_features_of,
)
from castwise.schemas import FEATURE_METADATA, FEATURE_VERSION, FEATURES, STABLE


def _zero(c: Column) -> Column:
    return F.coalesce(finite_or_zero(c), F.lit(0.0))


def _with_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("_t", time_features_of("x")).select("*", *[F.col(f"_t.{c}") for c in cols]).drop("_t")


def _with_moments(df: DataFrame) -> DataFrame:
    return _with_time(df, ["mean", "std", "min", "max", "skewness", "kurtosis", "autocorrelation_mean"])


def basic_features(df: DataFrame) -> DataFrame:
    """mean, population std, min and max of ``x``."""
    return _with_time(df, ["mean", "std", "min", "max"])


def shape_features(df: DataFrame) -> DataFrame:
    """Biased skewness and excess kurtosis; 0 for a constant window."""
    return _with_time(df, ["skewness", "kurtosis"])


def acf1(df: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation; 0 for a constant window."""
    return _with_time(df, ["autocorrelation_mean"])


def rate_of_change(df: DataFrame) -> DataFrame:
    """Mean and population std of step changes over the previous value; zeros before are dropped."""
    return _with_time(df, ["rate_of_change_mean", "rate_of_change_std"])


def ar1_features(df: DataFrame) -> DataFrame:
    """Slope and residual std of an AR(1) fit with intercept by least squares.

    When the lagged values are all equal the fit is not unique; the minimum-norm
    solution is taken, as a pseudo-inverse does.
    """
    return _with_time(df, ["autoreg_coef_mean", "residual_std_mean"])


def spectral_features(df: DataFrame) -> DataFrame:
    """Five features of the one-sided periodogram (Arrow batches)."""
    return df.withColumn("_f", spectral_features_of("x")).select("*", *[f"_f.{c}" for c in SPECTRAL]).drop("_f")


def stationarity(df: DataFrame) -> DataFrame:
    """1 when the augmented Dickey-Fuller test rejects a unit root at 5%."""
    return df.withColumn("stationarity", stationarity_of("x"))


def adf_statistics(df: DataFrame, lags: Sequence[int], out: str = "adf") -> DataFrame:
    """Unit-root statistics at fixed lags; 0 where undefined (constant windows)."""
    return df.withColumn(out, adf_at_lags("x", F.array(*[F.lit(int(k)) for k in lags])))


def build_features(
    windows: DataFrame, feature_type: str = "window_17", version: str = FEATURE_VERSION, keep: Sequence[str] = ()
) -> DataFrame:
    """Feature table: metadata and 17 columns, no shuffle, and the columns ``keep`` of the windows.

    The history is the only array read from the windows table; it goes through Arrow once. Features of the time domain, of the
    spectrum and the unit-root test, which takes most of the time, are three functions, so that a reader of some columns pays for those alone.
    """
    kept = [*STABLE, "history_length", "pred_length", *keep]
    parts = windows.select(*kept, time_features_of("x").alias("_t"), spectral_features_of("x").alias("_p"), stationarity_of("x").alias("stationarity"))
    full = parts.select(*kept, "_t.*", "_p.*", "stationarity")
    meta = full.withColumns(
        {
            "feature_version": F.lit(version),
            "feature_type": F.lit(feature_type),
            "feature_dim": F.lit(len(FEATURES)),
        }
    )
    return meta.select(*FEATURE_METADATA, *keep, *[_zero(F.col(c)).alias(c) for c in FEATURES])


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not metadata."""
    return [f.name for f in df.schema.fields if f.name not in FEATURE_METADATA and isinstance(f.dataType, T.NumericType)]


def validate_features(features: DataFrame, samples: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """One row per check: ``check``, number of violations, ``passed``.

    One full outer join on the key gives coverage both ways and the row counts; the
    other checks ride on the same pass.
    """
    fixed = ("feature_version", "feature_type", "feature_dim")
    per_key = features.groupBy("sample_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(~sample_key().eqNullSafe(F.col("sample_key"))).alias("_badkey"),
        F.count_if(_any_bad(cols)).alias("_nonfinite"),
        *[f(c).alias(f"_{n}_{c}") for c in fixed for n, f in (("lo", F.min), ("hi", F.max))],
    )
    wanted = samples.groupBy("sample_key").agg(F.count(F.lit(1)).alias("_wanted"))
    rows, want = F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_wanted"), F.lit(0))
    wide = per_key.join(wanted, "sample_key", "full_outer").agg(
        F.abs(rows - want).alias("row_count_difference"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_key"),
        F.count_if(F.col("_rows").isNull()).alias("missing_feature"),
        F.count_if(F.col("_wanted").isNull()).alias("extra_feature"),
        F.coalesce(F.sum("_badkey"), F.lit(0)).alias("key_mismatch"),
        F.coalesce(F.sum("_nonfinite"), F.lit(0)).alias("non_finite"),
        *[
            F.coalesce((F.min(f"_lo_{c}") != F.max(f"_hi_{c}")).cast("int"), F.lit(0)).alias(f"many_{c}")
            for c in fixed
        ],
    )
    return as_checks(wide)


def _any_bad(cols: Sequence[str]) -> Column:
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~F.coalesce(is_finite(F.col(c)), F.lit(False))
    return bad


def as_checks(wide: DataFrame) -> DataFrame:
    """A one-row table of violation counts as one row per check."""
    longs = wide.select(*[F.col(c).cast("long").alias(c) for c in wide.columns])
    return longs.unpivot([], list(wide.columns), "check", "violations").withColumn("passed", F.col("violations") == 0)
