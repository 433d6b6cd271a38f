"""Integrity checks of forecasts, labels and their companions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.functions.columns import is_finite, sample_key
from castwise.operators.features import as_checks
from castwise.schemas import REGIME, STABLE

METADATA = [*STABLE[1:], "history_length", "pred_length"]


def check_schema(df: DataFrame, cols: Sequence[str], version_col: str = "cache_version") -> DataFrame:
    """Missing columns (from the schema) and number of schema versions."""
    missing = [c for c in cols if c not in df.columns]
    versions = F.countDistinct(version_col) if version_col in df.columns else F.lit(0)
    return df.agg(F.lit(len(missing)).alias("missing_columns"), versions.alias("version_count")).withColumn(
        "passed", (F.col("missing_columns") == 0) & (F.col("version_count") == 1)
    )


def unstable_samples(df: DataFrame) -> DataFrame:
    """Samples whose metadata takes more than one value (NULL counts as a value).

    min/max of a null-safe text form need constant memory per key, unlike distinct sets.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in METADATA}
    agg = df.groupBy("sample_key").agg(*[(F.min(t) != F.max(t)).cast("int").alias(c) for c, t in text.items()])
    changed = sum((F.col(c) for c in METADATA), F.lit(0))
    return agg.withColumn("unstable_columns", changed).filter("unstable_columns > 0").select("sample_key", "unstable_columns")


def duplicate_forecasts(df: DataFrame) -> DataFrame:
    """(sample, expert) pairs with more than one row."""
    return df.groupBy("sample_key", "model_name").agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def _has_all(experts: Sequence[str]) -> Column:
    return sum((F.max((F.col("model_name") == e).cast("int")) for e in experts), F.lit(0))


def _has_other(experts: Sequence[str]) -> Column:
    return F.max((~F.col("model_name").isin(list(experts))).cast("int"))


def incomplete_samples(df: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Samples whose expert set is not exactly ``experts``."""
    g = df.groupBy("sample_key").agg(
        _has_all(experts).alias("present_experts"), _has_other(experts).alias("unknown_experts")
    )
    return g.filter((F.col("present_experts") < len(experts)) | (F.col("unknown_experts") > 0))


def inconsistent_truth(df: DataFrame) -> DataFrame:
    """Samples whose experts carry different ``y_true`` arrays."""
    h = F.xxhash64("y_true")
    return df.groupBy("sample_key").agg((F.min(h) != F.max(h)).alias("_d")).filter("_d").select("sample_key")


def _bad_array(name: str) -> Column:
    c, inf = F.col(name), F.lit(float("inf"))
    wrong = F.coalesce(F.size(c) != F.col("pred_length"), F.lit(True)) | c.isNull()
    # a search for NaN finds NULL instead of false where the array has a NULL
    finite = ~F.array_contains(c, F.lit(float("nan"))) & (F.coalesce(F.array_max(c), F.lit(0.0)) < inf) & (F.coalesce(F.array_min(c), F.lit(0.0)) > -inf)
    return wrong | ~F.coalesce(finite, F.lit(False))


def bad_arrays(df: DataFrame) -> DataFrame:
    """Forecast rows whose arrays are missing, of the wrong length or not finite."""
    return df.filter(_bad_array("y_true") | _bad_array("y_pred"))


def misaligned(df: DataFrame, reference: str, experts: Sequence[str]) -> DataFrame:
    """Samples that an expert has and the reference expert lacks, or the other way round, or with other metadata."""
    same = F.xxhash64(*[F.col(c) for c in METADATA])
    others = [e for e in experts if e != reference]
    ref = df.filter(F.col("model_name") == reference).select("sample_key", same.alias("_ref")).distinct()
    # every reference sample is expected once per other expert
    expected = ref.withColumn("model_name", F.explode(F.array(*[F.lit(e) for e in others])))
    own = df.filter(F.col("model_name") != reference).select("sample_key", "model_name", same.alias("_own"))
    j = expected.join(own, ["sample_key", "model_name"], "full_outer")
    kind = (
        F.when(F.col("_ref").isNull(), "not_in_reference")
        .when(F.col("_own").isNull(), "missing")
        .when(F.col("_ref") != F.col("_own"), "metadata")
    )
    return j.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("sample_key", "model_name", "kind")


def integrity_report(df: DataFrame, experts: Sequence[str]) -> DataFrame:
    """One row: records, samples, six violation counts, passed.

    Rows are counted per sample, samples are then summed. Metadata and truth meet as hashes: numbers
    are aggregated in a hash table, while smallest and largest texts would have all rows sorted first.
    """
    meta = F.xxhash64(*[F.col(c) for c in METADATA], *[F.col(c).isNull() for c in METADATA])
    h = F.xxhash64("y_true")
    bad = _bad_array("y_true") | _bad_array("y_pred")
    per_sample = df.groupBy("sample_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col("model_name") == e).cast("int").alias(f"_of{i}") for i, e in enumerate(experts)],
        _has_other(experts).alias("_other"),
        (F.min(meta) != F.max(meta)).cast("int").alias("_unstable"),
        (F.min(h) != F.max(h)).cast("int").alias("_truth"),
        F.count_if(bad).alias("_arrays"),
        F.count_if(~F.col("sample_key").eqNullSafe(sample_key())).alias("_key"),
    )
    of = [F.col(f"_of{i}") for i in range(len(experts))]
    excess = sum((F.greatest(n - 1, F.lit(0)) for n in of), F.lit(0))
    present = sum(((n > 0).cast("int") for n in of), F.lit(0))
    counts = per_sample.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("record_count"),
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.sum(excess), F.lit(0)).alias("duplicate_forecasts"),
        F.count_if((present < len(experts)) | (F.col("_other") > 0)).alias("incomplete_samples"),
        F.coalesce(F.sum("_unstable"), F.lit(0)).cast("long").alias("unstable_samples"),
        F.coalesce(F.sum("_truth"), F.lit(0)).cast("long").alias("inconsistent_truth"),
        F.coalesce(F.sum("_arrays"), F.lit(0)).alias("bad_arrays"),
        F.coalesce(F.sum("_key"), F.lit(0)).alias("bad_keys"),
    )
    faults = ["duplicate_forecasts", "incomplete_samples", "unstable_samples", "inconsistent_truth", "bad_arrays", "bad_keys"]
    clean = F.col("record_count") > 0
    for f in faults:
        clean = clean & (F.col(f) == 0)
    return counts.withColumn("passed", clean)


def require_passed(report: DataFrame) -> None:
    """Gate: stop unless a one-row report passed."""
    row = report.first()
    if row is None or not row["passed"]:
        raise ValueError(f"integrity check failed: {row.asDict() if row else 'empty report'}")


def coverage(df: DataFrame) -> DataFrame:
    """Rows per config, split, dataset and expert."""
    return df.groupBy("config_name", "split", "dataset_name", "model_name").agg(F.count(F.lit(1)).alias("row_count"))


def validate_outputs(labels: DataFrame, enriched: DataFrame, expected_samples: int) -> DataFrame:
    """One row: label and enrichment counts, null counts, key differences both ways, passed."""
    lab = labels.groupBy("sample_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("metric") == "mae").alias("_mae"),
        F.count_if(F.col("metric") == "mse").alias("_mse"),
        F.count_if(F.col("oracle_model").isNull() | F.col("oracle_value").isNull() | F.col("metric").isNull()).alias("_null"),
    )
    regime = [c for c in REGIME if c in enriched.columns]
    any_null = F.lit(False)
    for c in regime:
        any_null = any_null | F.col(c).isNull()
    enr = enriched.groupBy("sample_key").agg(F.count(F.lit(1)).alias("_erows"), F.count_if(any_null).alias("_enull"))
    j = lab.join(enr, "sample_key", "full_outer").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("label_rows"),
        F.coalesce(F.sum("_erows"), F.lit(0)).alias("enriched_rows"),
        F.count_if(F.col("_rows").isNotNull()).alias("label_keys"),
        F.count_if(F.col("_erows").isNotNull()).alias("enriched_keys"),
        F.coalesce(F.sum("_mae"), F.lit(0)).alias("mae_rows"),
        F.coalesce(F.sum("_mse"), F.lit(0)).alias("mse_rows"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("label_nulls"),
        F.coalesce(F.sum("_enull"), F.lit(0)).alias("enriched_nulls"),
        F.count_if(F.col("_erows").isNull()).alias("labels_without_regime"),
        F.count_if(F.col("_rows").isNull()).alias("regimes_without_label"),
    )
    n = F.lit(expected_samples)
    passed = (
        (F.col("label_rows") == 2 * n)
        & (F.col("enriched_rows") == n)
        & (F.col("label_keys") == n)
        & (F.col("enriched_keys") == n)
        & (F.col("mae_rows") == n)
        & (F.col("mse_rows") == n)
    )
    for c in ("label_nulls", "enriched_nulls", "labels_without_regime", "regimes_without_label"):
        passed = passed & (F.col(c) == 0)
    return j.withColumn("passed", passed)


def readiness(features: DataFrame, labels: DataFrame, samples: DataFrame, shard_count: int, shard_col: str = "shard") -> DataFrame:
    """Input readiness, one row per check with the seen and the wanted number.

    Each table gives its checks as rows; rows of one check meet in a small aggregation, so nothing is joined.
    """

    def numbers(df: DataFrame, rows: Sequence[tuple[str, Column, Column]]) -> DataFrame:
        counted = df.agg(*[c.cast("long").alias(f"_{k}{i}") for i, (_, found, want) in enumerate(rows) for k, c in (("f", found), ("w", want))])
        each = [F.struct(F.lit(n).alias("check"), F.col(f"_f{i}").alias("found"), F.col(f"_w{i}").alias("expected")) for i, (n, _, _) in enumerate(rows)]
        return counted.select(F.inline(F.array(*each)))

    nothing, rows = F.max(F.lit(None).cast("long")), F.count(F.lit(1))
    of_features = [
        ("feature_shards", F.countDistinct(shard_col), nothing),
        ("feature_rows", rows, nothing),
        ("feature_versions", F.countDistinct("feature_version"), nothing),
    ]
    union = numbers(features, of_features).unionByName(numbers(samples, [("feature_rows", nothing, rows)]))
    union = union.unionByName(numbers(labels, [("label_metrics", F.countDistinct("metric"), nothing)]))
    wanted = {"feature_shards": shard_count, "feature_versions": 1, "label_metrics": 2}
    fixed = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("check")]
    g = union.groupBy("check").agg(F.max("found").alias("found"), F.max("expected").alias("_e"))
    return g.select("check", "found", F.coalesce("_e", fixed).cast("long").alias("expected")).withColumn("ready", F.col("found") == F.col("expected"))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of the named columns (NULL as a value of its own), in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("row_count"))


def validate_embeddings(embeddings: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per check: unique keys, finite values, one dimension, equal key sets."""
    finite = F.forall("embedding", lambda v: F.coalesce(is_finite(v), F.lit(False)))
    per_key = embeddings.groupBy("sample_key").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("_bad"),
        F.min(F.size("embedding")).alias("_lo"), F.max(F.size("embedding")).alias("_hi"),
    )
    wanted = samples.select("sample_key").distinct().withColumn("_w", F.lit(1))
    wide = per_key.join(wanted, "sample_key", "full_outer").agg(
        F.count_if(F.col("_rows") > 1).alias("duplicate_key"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("non_finite"),
        F.coalesce((F.min("_lo") != F.max("_hi")).cast("int"), F.lit(0)).alias("many_dims"),
        F.count_if(F.col("_rows").isNull()).alias("missing_embedding"),
        F.count_if(F.col("_w").isNull()).alias("extra_embedding"),
    )
    return as_checks(wide)
