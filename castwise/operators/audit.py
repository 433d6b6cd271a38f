"""Item-level result tables: means, pivots, win tables, lineage and model selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castwise.functions.columns import ratio
from castwise.operators.ordering import exact_median, with_order

# Item score names.
ITEM_METRICS = ["MSE", "MAE", "MASE", "MAPE", "SMAPE"]


def present_metrics(df: DataFrame) -> list[str]:
    return [m for m in ITEM_METRICS if m in df.columns]


def win_rates(choices: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Wins, win rate, mean and exact median regret per cell and expert (long on expert)."""
    cell = ["metric", "config_name", "cluster", "group_name"]
    pairs = F.array(
        *[
            F.struct(
                F.lit(e).alias("model"),
                F.col(f"{e}_regret").alias("regret"),
                (F.col("oracle_model") == e).cast("int").alias("won"),
            )
            for e in experts
        ]
    )
    long = choices.select(*cell, F.inline(pairs))
    stats = long.groupBy(*cell, "model").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("won").alias("win_count"),
        F.avg("regret").alias("mean_regret_to_oracle"),
    )
    medians = exact_median(long, "regret", [*cell, "model"], "median_regret_to_oracle")
    return stats.join(medians, [*cell, "model"]).select(
        *cell,
        "model",
        "item_count",
        "win_count",
        ratio(F.col("win_count"), F.col("item_count")).alias("win_rate"),
        "mean_regret_to_oracle",
        "median_regret_to_oracle",
    )


def check_item_metrics(
    items: DataFrame, experts: Sequence[str], configs: Sequence[str], metrics: Sequence[str] = ("MAE", "MSE")
) -> DataFrame:
    """One row per input check: duplicate keys, missing values, missing experts, row count."""
    kept = F.col("model").isin(list(experts)) & F.col("config_name").isin(list(configs))
    per_key = items.groupBy("config_name", "item_id", "model").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(sum((F.col(m).isNull().cast("int") for m in metrics), F.lit(0))).alias("_null"),
    )
    g = per_key.agg(
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum("_null").alias("missing_values"),
        F.sum(F.when(kept, F.col("_n")).otherwise(0)).alias("_rows"),
        F.countDistinct(F.when(kept, F.col("item_id"))).alias("_items"),
        *[F.max((F.col("model") == e).cast("int")).alias(f"_has_{e}") for e in experts],
    )
    absent = sum((1 - F.coalesce(F.col(f"_has_{e}"), F.lit(0)) for e in experts), F.lit(0))
    wide = g.select(
        F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows"),
        F.coalesce("missing_values", F.lit(0)).alias("missing_values"),
        absent.alias("missing_experts"),
        F.abs(F.coalesce("_rows", F.lit(0)) - F.col("_items") * (len(experts) * len(configs))).alias("row_count_difference"),
    )
    from castwise.operators.features import as_checks

    return as_checks(wide)


def overall_metrics(items: DataFrame, group: Sequence[str] = ("model", "config_name")) -> DataFrame:
    """Mean of every metric per model and config, with item and sample counts."""
    return items.groupBy(*group).agg(
        F.countDistinct("item_id").alias("item_count"),
        F.sum("n_samples").alias("sample_count"),
        *[F.avg(m).alias(m) for m in present_metrics(items)],
    )


def cell_metrics(items: DataFrame) -> DataFrame:
    """Per cell means of every metric and the population std of MAE."""
    spread = [F.stddev_pop("MAE").alias("MAE_std")] if "MAE" in items.columns else []
    return items.groupBy("model", "config_name", "cluster", "group_name").agg(
        F.countDistinct("item_id").alias("item_count"),
        F.sum("n_samples").alias("sample_count"),
        *[F.avg(m).alias(f"{m}_mean") for m in present_metrics(items)],
        *spread,
    )


def mae_pivot(overall: DataFrame, configs: Sequence[str], value: str = "MAE") -> DataFrame:
    """Model x config table of a mean metric."""
    return overall.groupBy("model").pivot("config_name", list(configs)).agg(F.first(value, ignorenulls=True))


def cell_pivot(cells: DataFrame, configs: Sequence[str], experts: Sequence[str], value: str = "MAE_mean") -> DataFrame:
    """Cell x (config, model) table with ``config__model`` columns."""
    names = [f"{c}__{e}" for c in configs for e in experts]
    keyed = cells.withColumn("_name", F.concat_ws("__", "config_name", "model"))
    return keyed.groupBy("cluster", "group_name").pivot("_name", names).agg(F.first(value, ignorenulls=True))


def ordered_table(df: DataFrame, orders: dict[str, Sequence[str]]) -> DataFrame:
    """Rows sorted by custom display orders, with the order columns kept."""
    for col, order in orders.items():
        df = with_order(df, col, order)
    return df.orderBy(*[f"{c}_order" for c in orders])


def best_epoch(epochs: DataFrame, by: str = "mse", versus: str = "mae", run: Sequence[str] = ("model", "config_name")) -> DataFrame:
    """Best saved epoch per run by one validation metric, compared with the best by another.

    Equal metrics go to the earlier epoch.
    """
    saved = epochs.filter("checkpoint_saved")
    best = saved.groupBy(*run).agg(
        F.min(F.struct(f"validation_{by}", "epoch", f"validation_{versus}")).alias("_b"),
        F.min(F.struct(f"validation_{versus}", "epoch")).alias("_v"),
        F.count(F.lit(1)).alias("epoch_count"),
    )
    return best.select(
        *run,
        "epoch_count",
        F.col("_b.epoch").alias(f"{by}_best_epoch"),
        F.col("_v.epoch").alias(f"{versus}_best_epoch"),
        F.col(f"_b.validation_{by}").alias(f"validation_{by}"),
        F.col(f"_b.validation_{versus}").alias(f"validation_{versus}"),
        (~F.col("_b.epoch").eqNullSafe(F.col("_v.epoch"))).alias(f"{by}_best_differs_from_{versus}_best"),
    )


def epoch_of_file(path: Column, kind: str) -> Column:
    """Epoch in a checkpoint file name ``<kind>_epoch=<n>_step=<n>_<rest>.ckpt``; NULL for other names."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, rf"^{kind}_epoch=(\d+)_step=\d+_.*\.ckpt$", 1), F.lit("")).cast("int")


def best_checkpoint(
    curve: DataFrame, files: DataFrame, by: str = "mse", versus: str = "mae", run: Sequence[str] = ("model", "config_name")
) -> DataFrame:
    """Best saved epoch per run: validation curve joined with the checkpoints that exist as files.

    ``curve``: run columns, ``epoch`` and ``validation_<metric>``. ``files``: run columns, ``path`` and ``modified``; names with
    ``ckpt`` are saved epochs, the latest with ``best`` is the choice of the run itself (by ``versus``). An epoch without a
    checkpoint cannot win; a checkpoint without a point on the curve fails the job, as does a run without
    any checkpoint. Equal metrics go to the earlier epoch; of several files of one epoch the last by name counts.
    """
    named = files.select(*run, "path", "modified", epoch_of_file(F.col("path"), "ckpt").alias("_ckpt"), epoch_of_file(F.col("path"), "best").alias("_best"))
    saved = named.filter("_ckpt IS NOT NULL").groupBy(*run, F.col("_ckpt").alias("epoch")).agg(F.max("path").alias("_path"))
    own = named.filter("_best IS NOT NULL").groupBy(*run).agg(F.max(F.struct("modified", "path", "_best")).alias("_own"))
    both = curve.withColumn("_seen", F.lit(True)).join(saved, [*run, "epoch"], "full_outer")
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in (*run, "epoch")])
    point = F.when(F.col("_seen").isNotNull(), F.col(f"validation_{by}")).otherwise(
        F.raise_error(F.concat(F.lit("checkpoint without a point on the curve: "), text)).cast("double")
    )
    usable = F.col("_path").isNotNull() & F.col("_point").isNotNull()
    best = both.withColumn("_point", point).groupBy(*run).agg(
        F.min(F.when(usable, F.struct("_point", "epoch", f"validation_{versus}", "_path"))).alias("_b"), F.count_if(usable).alias("epoch_count")
    )
    found = F.when(F.col("epoch_count") > 0, F.col("_b.epoch")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("no checkpoint with a curve:"), *[F.col(c).cast("string") for c in run])).cast("int")
    )
    return best.join(own, list(run), "left").select(
        *run,
        "epoch_count",
        found.alias(f"{by}_best_epoch"),
        F.col("_own._best").alias(f"{versus}_best_epoch"),
        F.col("_b._point").alias(f"validation_{by}"),
        F.col(f"_b.validation_{versus}").alias(f"validation_{versus}"),
        (~F.col("_b.epoch").eqNullSafe(F.col("_own._best"))).alias(f"{by}_best_differs_from_{versus}_best"),
        F.col("_b._path").alias("checkpoint_path"),
    )


def lineage(forecasts: DataFrame) -> DataFrame:
    """Where each model's forecasts come from."""
    return (
        forecasts.select("model_name", "config_name", "expert_version", "checkpoint_selection")
        .distinct()
        .withColumn("checkpoint_selection", F.coalesce("checkpoint_selection", F.lit("not_applicable")))
    )


def latency_summary(measurements: DataFrame, group: Sequence[str]) -> DataFrame:
    """Samples, elapsed seconds and seconds per sample of each group; mean over its batches."""
    return measurements.groupBy(*group).agg(
        F.count(F.lit(1)).alias("batch_count"),
        F.sum("sample_count").alias("sample_count"),
        F.sum("elapsed").alias("elapsed"),
        ratio(F.sum("elapsed"), F.sum("sample_count")).alias("seconds_per_sample"),
        F.avg(ratio(F.col("elapsed"), F.col("sample_count"))).alias("mean_batch_seconds_per_sample"),
    )


def rewards(labels: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Reward view: one row per (sample, metric, expert) with ``-error`` and ``-regret``."""
    from castwise.schemas import STABLE

    acts = F.array(
        *[
            F.struct(F.lit(e).alias("action"), (-F.col(e)).alias("reward"), (-F.col(f"{e}_regret")).alias("regret_reward"))
            for e in experts
        ]
    )
    return labels.select(*STABLE, "metric", F.inline(acts))


def ranked_methods(comparison: DataFrame) -> DataFrame:
    """Rank of every method inside its config."""
    w = W.partitionBy("config_name").orderBy("mae_like_value", "method")
    return comparison.withColumn("method_rank", F.row_number().over(w))
