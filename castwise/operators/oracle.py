"""Hindsight-best expert per window and its summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwise.functions.columns import argmin_name, ratio
from castwise.schemas import METRICS, STABLE


def error_matrix(forecasts: DataFrame, metric: str, experts: Sequence[str], keys: Sequence[str] = STABLE) -> DataFrame:
    """One row per sample, one error column per expert.

    Conditional maxima pivot in a single shuffle on the sample; ``pivot`` would first
    shuffle on (sample, expert).  A repeated (sample, expert) and an
    expert that is not in ``experts`` fail the job; a missing one is NULL.
    """
    cells = [F.max(F.when(F.col("model_name") == e, F.col(metric))).alias(e) for e in experts]
    repeated = [F.count_if(F.col("model_name") == e).alias(f"_n_{k}") for k, e in enumerate(experts)]
    most = F.greatest(*[F.col(f"_n_{k}") for k in range(len(experts))], F.lit(0))
    first = experts[0]
    other = F.count_if(~F.col("model_name").isin(list(experts))).alias("_other")
    fault = F.when(most > 1, "an expert is repeated in a sample").when(F.col("_other") > 0, "a sample has an unknown expert")
    checked = F.when(fault.isNull(), F.col(first)).otherwise(F.raise_error(fault).cast("double"))
    return forecasts.groupBy(*keys).agg(*cells, *repeated, other).select(*keys, checked.alias(first), *experts[1:])


def oracle_labels(
    forecasts: DataFrame, experts: Sequence[str], metrics: Sequence[str] = METRICS, keys: Sequence[str] = STABLE
) -> DataFrame:
    """Oracle label rows, one per sample and metric.

    Both metrics come from one shuffle on the sample: the experts' errors are
    combined map-side into one column per (metric, expert), then opened by metric.
    A sample that lacks an expert, repeats one or has another than ``experts`` fails the job.
    """
    cells = [
        F.max(F.when(F.col("model_name") == e, F.col(m))).alias(f"{m}__{e}") for m in metrics for e in experts
    ]
    wide = forecasts.groupBy(*keys).agg(*cells, F.count(F.lit(1)).alias("_rows"))
    per_metric = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{e}").alias(e) for e in experts])
            for m in metrics
        ]
    )
    long = wide.select(*keys, "_rows", F.inline(per_metric))
    # every expert has a value and there are no more rows than experts: each occurs once, and no other does
    complete = F.col("_rows") == len(experts)
    for e in experts:
        complete = complete & F.col(e).isNotNull()
    guarded = F.when(complete, F.least(*[F.col(e) for e in experts])).otherwise(
        F.raise_error(F.lit("a sample does not have each expert once")).cast("double")
    )
    return with_regrets(long.withColumn("oracle_value", guarded), experts, keys)


def oracle_labels_wide(
    df: DataFrame, experts: Sequence[str], errors: Mapping[str, str], keys: Sequence[str] = STABLE
) -> DataFrame:
    """:func:`oracle_labels` of rows that hold a sample's errors side by side; without a shuffle.

    ``errors`` names for every metric the array column with one value per expert, in the order of ``experts``.
    Samples must not be repeated; an array of another size, or one with a gap, fails the job.
    """
    per_metric = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("_e")) for m, c in errors.items()])
    long = df.select(*keys, F.inline(per_metric))
    cells = [F.get("_e", F.lit(i)) for i in range(len(experts))]
    complete = F.size("_e") == len(experts)
    for c in cells:
        complete = complete & c.isNotNull()
    guarded = F.when(complete, F.least(*cells)).otherwise(
        F.raise_error(F.lit("a sample does not have each expert once")).cast("double")
    )
    named = long.select(*keys, "metric", *[c.alias(e) for c, e in zip(cells, experts)], guarded.alias("oracle_value"))
    return with_regrets(named, experts, keys)


def with_regrets(long: DataFrame, experts: Sequence[str], keys: Sequence[str] = STABLE) -> DataFrame:
    """Oracle model, values and regrets for rows that carry one error column per expert."""
    per_expert: list[Column] = []
    for e in experts:
        per_expert += [F.col(e), (F.col(e) - F.col("oracle_value")).alias(f"{e}_regret")]
    return long.select(
        *keys,
        "metric",
        argmin_name([F.col(e) for e in experts], experts).alias("oracle_model"),
        "oracle_value",
        F.col("oracle_value").alias("oracle_top1_value"),
        *per_expert,
    )


def _mean_and_wins(experts: Sequence[str]) -> list[Column]:
    means = [F.avg(e).alias(f"_m_{e}") for e in experts]
    wins = [F.count_if(F.col("oracle_model") == e).alias(f"_w_{e}") for e in experts]
    return means + wins


def _best_single(df: DataFrame, experts: Sequence[str], digits: int = 12) -> DataFrame:
    """Expert with the lowest mean; means equal up to summation order count as ties."""
    means = [F.round(f"_m_{e}", digits) for e in experts]
    best = df.withColumn("best_single_model", argmin_name(means, experts)).withColumn(
        "best_single_value", F.least(*[F.col(f"_m_{e}") for e in experts])
    )
    gap = F.col("best_single_value") - F.col("oracle_value")
    return best.withColumn("oracle_gap_abs", gap).withColumn(
        "oracle_gap_pct", F.coalesce(ratio(gap, F.col("best_single_value")), F.lit(0.0))
    )


def oracle_summary(labels: DataFrame, group: Sequence[str], experts: Sequence[str]) -> DataFrame:
    """Per group: rows, best single expert, oracle mean, gap and win rates."""
    agg = labels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("oracle_value").alias("oracle_value"), *_mean_and_wins(experts)
    )
    return _best_single(agg, experts).select(
        *group,
        "sample_count",
        "best_single_model",
        "best_single_value",
        "oracle_value",
        "oracle_gap_abs",
        "oracle_gap_pct",
        *[ratio(F.col(f"_w_{e}"), F.col("sample_count")).alias(f"{e}_win_rate") for e in experts],
    )


def oracle_summary_levels(labels: DataFrame, levels: Sequence[Sequence[str]], experts: Sequence[str]) -> DataFrame:
    """Several grouping levels of :func:`oracle_summary` in one GROUPING SETS pass.

    ``level`` names the columns a row is grouped by; the others are NULL.
    """
    cols = list(dict.fromkeys(c for level in levels for c in level))
    agg = labels.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("oracle_value").alias("oracle_value"),
        *_mean_and_wins(experts),
    )
    return (
        _best_single(agg.withColumn("level", level_name(F.col("_gid"), cols)), experts)
        .select(
            "level",
            *cols,
            "sample_count",
            "best_single_model",
            "best_single_value",
            "oracle_value",
            "oracle_gap_abs",
            "oracle_gap_pct",
            *[ratio(F.col(f"_w_{e}"), F.col("sample_count")).alias(f"{e}_win_rate") for e in experts],
        )
    )


def level_name(grouping_id: Column, cols: Sequence[str]) -> Column:
    """Comma list of the columns that a grouping-sets row is grouped by."""
    n = len(cols)
    kept = [
        F.when(F.shiftright(grouping_id, n - 1 - i).bitwiseAND(F.lit(1)) == 0, F.lit(c)) for i, c in enumerate(cols)
    ]
    return F.concat_ws(",", *kept)


def _winner_entropy(experts: Sequence[str], total: Column) -> Column:
    """Entropy of win shares over ln(number of experts); 0 when one expert wins all."""
    parts = F.lit(0.0)
    for e in experts:
        p = ratio(F.col(f"_w_{e}"), total)
        parts = parts + F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))
    return parts / F.log(F.lit(float(len(experts))))


def audit_config(choices: DataFrame, experts: Sequence[str], group: Sequence[str] = ("metric", "config_name")) -> DataFrame:
    """Item-level audit per group.

    Adds to the oracle summary how many items pick another expert than the best
    single one.  That count is ``items - wins of the best single expert``, so the
    second pass over the items (compare each with the winner) is not needed.
    """
    agg = choices.groupBy(*group).agg(
        F.count(F.lit(1)).alias("item_count"), F.avg("oracle_value").alias("oracle_value"), *_mean_and_wins(experts)
    )
    best = _best_single(agg, experts)
    wins_of_best = F.coalesce(*[F.when(F.col("best_single_model") == e, F.col(f"_w_{e}")) for e in experts])
    others = F.col("item_count") - wins_of_best
    return best.select(
        *group,
        "item_count",
        F.lit(len(experts)).alias("model_count"),
        "best_single_model",
        F.col("best_single_value").alias("best_single_metric"),
        F.col("oracle_value").alias("oracle_top1_metric"),
        "oracle_gap_abs",
        "oracle_gap_pct",
        others.alias("oracle_uses_non_best_item_count"),
        ratio(others, F.col("item_count")).alias("oracle_uses_non_best_item_rate"),
        _winner_entropy(experts, F.col("item_count")).alias("winner_entropy_norm"),
        *[ratio(F.col(f"_w_{e}"), F.col("item_count")).alias(f"{e}_win_rate") for e in experts],
    )


def audit_cells(choices: DataFrame, experts: Sequence[str]) -> DataFrame:
    """:func:`audit_config` inside every regime cell."""
    cells = audit_config(choices, experts, ["metric", "config_name", "cluster", "group_name"])
    return (
        cells.drop("model_count", "oracle_uses_non_best_item_count", "oracle_uses_non_best_item_rate")
        .withColumnRenamed("best_single_model", "cell_best_single_model")
        .withColumnRenamed("best_single_metric", "cell_best_single_metric")
    )
