"""Table schemas and fixed names shared by all operators."""

from pyspark.sql import types as T

# Default expert order; ties always go to the earlier name.
DEFAULT_EXPERTS = ["DLinear", "PatchTST", "CrossFormer", "ES", "NaiveForecaster"]

SPLITS = ["vali", "test"]
METRICS = ["mae", "mse"]
CACHE_VERSION = "forecast_cache_v1"
FEATURE_VERSION = "window_features_v1"

SERIES = ["dataset_name", "item_id", "channel_id"]
STABLE = ["sample_key", "config_name", "split", "dataset_name", "item_id", "channel_id", "window_index"]

# Names of the 17 history features.
FEATURES = [
    "mean",
    "std",
    "min",
    "max",
    "skewness",
    "kurtosis",
    "autocorrelation_mean",
    "stationarity",
    "rate_of_change_mean",
    "rate_of_change_std",
    "autoreg_coef_mean",
    "residual_std_mean",
    "frequency_mean",
    "frequency_peak",
    "spectral_entropy",
    "spectral_skewness",
    "spectral_kurtosis",
]

FEATURE_METADATA = ["feature_version", *STABLE, "history_length", "pred_length", "feature_type", "feature_dim"]

# Item-level regime columns.
REGIME_CATEGORIES = [
    "forecastability_cat",
    "season_strength_cat",
    "trend_strength_cat",
    "cv_cat",
    "missing_ratio_cat",
]
REGIME = ["cluster", "group_name", *REGIME_CATEGORIES]

_DOUBLES = T.ArrayType(T.DoubleType())


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_SAMPLE_FIELDS = [
    ("sample_key", T.StringType()),
    ("config_name", T.StringType()),
    ("split", T.StringType()),
    ("dataset_name", T.StringType()),
    ("item_id", T.LongType()),
    ("channel_id", T.IntegerType()),
    ("window_index", T.IntegerType()),
    ("history_length", T.IntegerType()),
    ("pred_length", T.IntegerType()),
]

PANEL_SCHEMA = _struct(
    ("dataset_name", T.StringType()),
    ("item_id", T.LongType()),
    ("channel_id", T.IntegerType()),
    ("step", T.IntegerType()),
    ("raw", T.DoubleType()),
    ("value", T.DoubleType()),
    ("split", T.StringType()),
    ("pos", T.IntegerType()),
)

SAMPLES_SCHEMA = _struct(*_SAMPLE_FIELDS, ("selection_strategy", T.StringType()))

WINDOWS_SCHEMA = _struct(*_SAMPLE_FIELDS, ("x", _DOUBLES), ("y_true", _DOUBLES))

FORECASTS_SCHEMA = _struct(
    ("cache_version", T.StringType()),
    *_SAMPLE_FIELDS,
    ("model_name", T.StringType()),
    ("expert_version", T.StringType()),
    ("checkpoint_selection", T.StringType()),
    ("y_true", _DOUBLES),
    ("y_pred", _DOUBLES),
    ("mae", T.DoubleType()),
    ("mse", T.DoubleType()),
)

REGIMES_SCHEMA = _struct(
    ("item_id", T.LongType()),
    ("cluster", T.IntegerType()),
    ("group_name", T.StringType()),
    *[(name, T.StringType()) for name in REGIME_CATEGORIES],
)

EVAL_JSON_SCHEMA = _struct(
    (
        "final_results",
        T.ArrayType(
            _struct(
                ("user_id", T.LongType()),
                ("n_samples", T.LongType()),
                ("eval_time", T.DoubleType()),
                ("metrics", T.MapType(T.StringType(), T.DoubleType())),
            )
        ),
    )
)


def labels_schema(experts):
    """Oracle labels: long on metric, one value and one regret column per expert."""
    stable = [f for f in _SAMPLE_FIELDS if f[0] in STABLE]
    per_expert = [(n, T.DoubleType()) for e in experts for n in (e, f"{e}_regret")]
    return _struct(
        *stable,
        ("metric", T.StringType()),
        ("oracle_model", T.StringType()),
        ("oracle_value", T.DoubleType()),
        ("oracle_top1_value", T.DoubleType()),
        *per_expert,
    )
