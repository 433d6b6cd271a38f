"""Fusion by weights and its calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from math import isclose

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.functions.columns import (
    WEIGHT_FLOOR,
    asum,
    entropy,
    is_finite,
    let,
    normalize,
    pick,
    ratio,
    softmax,
)
from castwise.functions.spectral import PIECE_BYTES, by_length
from castwise.operators.features import as_checks
from castwise.operators.joins import stack_experts, strict_join
from castwise.schemas import STABLE


def weights_array(experts: Sequence[str], prefix: str = "weight_") -> Column:
    return F.array(*[F.col(f"{prefix}{e}") for e in experts])


def _name_at(position: Column, experts: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in experts]), position.cast("int"))


def _first_max(w: Column) -> Column:
    return F.array_position(w, F.array_max(w))


def weight_stats(df: DataFrame, experts: Sequence[str], weights: str = "weights") -> DataFrame:
    """Entropy, normalized entropy, max weight, selected expert and active experts of a weight array."""
    w = F.col(weights)
    names = F.array(*[F.lit(e) for e in experts])
    active = F.filter(F.zip_with(names, w, lambda n, v: F.when(v > WEIGHT_FLOOR, n)), lambda n: n.isNotNull())
    return (
        df.withColumn("selected_model", _name_at(_first_max(w), experts))
        .withColumn("weight_entropy", entropy(w))
        .withColumn("normalized_weight_entropy", F.col("weight_entropy") / F.log(F.lit(float(len(experts)))))
        .withColumn("max_weight", F.array_max(w))
        .withColumn("active_weight_count", F.size(active))
        .withColumn("active_models", F.array_join(active, ","))
    )


def hard_route(weights: DataFrame, labels: DataFrame, experts: Sequence[str], router_name: str) -> DataFrame:
    """Top-1 routing of weight rows (stable columns and ``weights``) against label rows of one metric."""
    lab = labels.select(*STABLE, "oracle_model", "oracle_value", *experts)
    return routed_rows(strict_join(weights.select(*STABLE, "weights"), lab), experts, router_name)


def routed_rows(rows: DataFrame, experts: Sequence[str], router_name: str, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`hard_route` of rows that hold a sample's weights and its label side by side, and their columns ``keep``; without a shuffle."""
    joined = weight_stats(rows, experts)
    value = pick(F.col("selected_model"), experts, [F.col(e) for e in experts])
    return (
        joined.withColumn("router_name", F.lit(router_name))
        .withColumn("selected_value", value)
        .withColumn("regret_to_oracle", value - F.col("oracle_value"))
        .withColumn("oracle_label_correct", F.col("selected_model") == F.col("oracle_model"))
        .select(
            "router_name",
            *STABLE,
            "selected_model",
            "selected_value",
            "oracle_model",
            "oracle_value",
            "regret_to_oracle",
            "oracle_label_correct",
            "weight_entropy",
            "normalized_weight_entropy",
            "max_weight",
            *[F.element_at("weights", i + 1).alias(f"weight_{e}") for i, e in enumerate(experts)],
            *keep,
        )
    )


def _fused_at(y_preds: Column, weights: Column, n_experts: int, i: Column) -> Column:
    """Weighted forecast at 0-based step ``i``; the experts are unrolled into a sum of products."""
    out = F.get(weights, F.lit(0)) * F.get(F.get(y_preds, F.lit(0)), i)
    for k in range(1, n_experts):
        out = out + F.get(weights, F.lit(k)) * F.get(F.get(y_preds, F.lit(k)), i)
    return out


def fused_errors(y_true: Column, y_preds: Column, weights: Column, n_experts: int) -> Column:
    """Struct (mae, mse) of the weighted forecast, from one array of residuals."""
    residuals = F.transform(y_true, lambda y, i: _fused_at(y_preds, weights, n_experts, i) - y)
    return let(
        residuals,
        lambda r: F.struct(
            (F.aggregate(r, F.lit(0.0), lambda acc, e: acc + F.abs(e)) / F.size(r)).alias("mae"),
            (F.aggregate(r, F.lit(0.0), lambda acc, e: acc + e * e) / F.size(r)).alias("mse"),
        ),
    )


def fuse(y_preds: Column, weights: Column, n_experts: int) -> Column:
    """The weighted forecast as an array."""
    return F.transform(F.get(y_preds, F.lit(0)), lambda _, i: _fused_at(y_preds, weights, n_experts, i))


def soft_fuse(routed: DataFrame, forecasts: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Errors of the weighted forecast and of the hard pick, recomputed from arrays.

    Only forecasts of routed samples are stacked (semi join before the grouping);
    stored expert errors ride along as ``<expert>_mae_from_manifest`` / ``_mse_``.
    """
    wanted = forecasts.join(routed.select("sample_key"), "sample_key", "left_semi")
    arrays = stack_experts(wanted, experts, ["mae", "mse"])
    return soft_fused_rows(strict_join(routed, arrays, ["sample_key"]), routed.columns, experts)


def soft_fused_rows(j: DataFrame, columns: Sequence[str], experts: Sequence[str]) -> DataFrame:
    """:func:`soft_fuse` of routed rows (``columns``) that hold ``y_true, y_preds, mae_by_expert, mse_by_expert`` as well; without a shuffle."""
    stored = [
        F.get(f"{m}_by_expert", F.lit(k)).alias(f"{e}_{m}_from_manifest") for k, e in enumerate(experts) for m in ("mae", "mse")
    ]
    one_hot = F.array(*[F.when(F.col("selected_model") == e, 1.0).otherwise(0.0) for e in experts])
    y, p, m = F.col("y_true"), F.col("y_preds"), len(experts)
    out = j.withColumn("_soft", fused_errors(y, p, weights_array(experts), m)).withColumn(
        "_hard", fused_errors(y, p, one_hot, m)
    )
    return out.select(
        *columns,
        *stored,
        F.col("_soft.mae").alias("soft_fusion_mae"),
        F.col("_soft.mse").alias("soft_fusion_mse"),
        F.col("_hard.mae").alias("hard_top1_mae_from_array"),
        F.col("_hard.mse").alias("hard_top1_mse_from_array"),
    )


def summarize_soft(fused: DataFrame) -> DataFrame:
    """Fused and hard array errors per router and config."""
    means = [
        "soft_fusion_mae",
        "soft_fusion_mse",
        "hard_top1_mae_from_array",
        "hard_top1_mse_from_array",
        "oracle_value",
    ]
    g = fused.groupBy("router_name", "config_name").agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(c).alias(c) for c in means],
        F.avg("weight_entropy").alias("mean_weight_entropy"),
        F.avg("normalized_weight_entropy").alias("mean_normalized_weight_entropy"),
        F.avg("max_weight").alias("mean_max_weight"),
    )
    return g.withColumn("router_name", F.concat("router_name", F.lit("_soft_fusion")))


# --- calibration --------------------------------------------------------------


@dataclass(frozen=True)
class Strategy:
    """One calibration setting; ``top_k`` None keeps every expert."""

    name: str
    family: str
    temperature: float
    top_k: int | None


# Default sweep settings (None keeps all experts).
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0]
TOP_KS = [None, 1, 2, 3]


# Fixed values: (name, family) of a setting by whether experts are cut and whether the temperature differs from 1.
HARD = ("top1_hard", "top1_hard")
NAMES = {
    (False, False): ("raw_soft", "raw_soft"),
    (False, True): ("soft_T{t}", "temperature_soft"),
    (True, False): ("top{k}_fusion", "top{k}_fusion"),
    (True, True): ("top{k}_fusion_T{t}", "top{k}_temperature_fusion"),
}


def strategies(temperatures: Sequence[float] = TEMPERATURES, top_ks: Sequence[int | None] = TOP_KS) -> list[Strategy]:
    """The product of both lists over *effective* settings: choosing one expert ignores the temperature."""
    if min(temperatures) <= 0:
        raise ValueError("temperatures must be positive")
    settings = dict.fromkeys((k, 1.0 if k == 1 else float(t)) for k, t in product(top_ks, sorted(temperatures)))
    grid = []
    for k, t in settings:
        patterns = HARD if k == 1 else NAMES[k is not None, not isclose(t, 1.0)]
        name, family = (p.format(k=k, t=format(t, "g").replace(".", "p")) for p in patterns)
        grid.append(Strategy(name, family, t, k))
    return grid


GRID_SCHEMA = "strategy_name string, strategy_family string, temperature double, top_k int"


def strategy_grid(spark: SparkSession, grid: Sequence[Strategy] | None = None) -> DataFrame:
    """The strategies as a small table."""
    rows = [(s.name, s.family, float(s.temperature), s.top_k) for s in grid or strategies()]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def _strategy_struct(s: Strategy) -> Column:
    return F.struct(
        F.lit(s.name).alias("strategy_name"),
        F.lit(s.family).alias("strategy_family"),
        F.lit(float(s.temperature)).alias("temperature"),
        F.lit(s.top_k).cast("int").alias("top_k"),
    )


def with_strategies(df: DataFrame, grid: Sequence[Strategy] | None = None) -> DataFrame:
    """Each row once per strategy: the short list is a literal opened in place, without a join."""
    return df.select("*", F.inline(F.array(*[_strategy_struct(s) for s in grid or strategies()])))


def calibrated(weights: Column, temperature: Column, top_k: Column, n_experts: int) -> Column:
    """``p ** (1/T)`` by logs, normalized, then the top-k kept and normalized again.

    Equal weights keep expert order.
    """
    floor = F.lit(WEIGHT_FLOOR)
    logits = F.transform(weights, lambda p: F.log(F.least(F.greatest(p, floor), F.lit(1.0))) / temperature)

    def cut(scaled: Column) -> Column:
        order = F.array_sort(
            F.zip_with(
                scaled,
                F.sequence(F.lit(1), F.lit(n_experts)),
                lambda w, i: F.struct((-w).alias("neg"), i.alias("i")),
            )
        )
        kept = F.transform(F.slice(order, F.lit(1), F.least(top_k, F.lit(n_experts))), lambda s: s["i"])
        zeroed = let(
            kept,
            lambda keep: F.transform(
                scaled, lambda w, i: F.when(F.array_contains(keep, i + 1), w).otherwise(F.lit(0.0))
            ),
        )
        return normalize(zeroed)

    soft = softmax(logits)
    return let(soft, lambda s: F.when(top_k.isNull() | (top_k >= n_experts), s).otherwise(cut(s)))


def calibrate(df: DataFrame, temperature: float, top_k: int | None, experts: Sequence[str]) -> DataFrame:
    """One strategy on the ``weights`` array."""
    k = F.lit(top_k).cast("int")
    return df.withColumn("weights", calibrated(F.col("weights"), F.lit(float(temperature)), k, len(experts)))


def _sweep_batch(w: np.ndarray, preds: np.ndarray, true: np.ndarray, grid: Sequence[Strategy]):
    """Calibrated weights (rows, strategies, experts), mae and mse of every strategy on a batch."""
    m = w.shape[1]
    logs = np.log(np.clip(w, WEIGHT_FLOOR, 1.0))
    out = np.empty((len(w), len(grid), m))
    for j, s in enumerate(grid):
        z = logs / s.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        if s.top_k is not None and s.top_k < m:
            # stable order: equal weights keep expert order
            place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
            p = np.where(place < s.top_k, p, 0.0)
            p /= p.sum(axis=1, keepdims=True)
        out[:, j] = p
    error = out @ preds - true[:, None, :]
    return out, np.abs(error).mean(axis=2), np.square(error).mean(axis=2)


def _swept_errors(grid: Sequence[Strategy]):
    """Arrow function: (weights, y_preds, y_true) -> one (weights, mae, mse) struct per strategy."""
    doubles = T.ArrayType(T.DoubleType())
    entry = T.StructType(
        [T.StructField("weights", doubles), T.StructField("mae", T.DoubleType()), T.StructField("mse", T.DoubleType())]
    )
    n = len(grid)

    @F.arrow_udf(T.ArrayType(entry))
    def run(weights: pa.Array, y_preds: pa.Array, y_true: pa.Array) -> pa.Array:
        rows_total = len(weights)
        m = len(weights.flatten()) // max(rows_total, 1)
        w_all = np.asarray(weights.flatten(), dtype=float).reshape(rows_total, m)
        cal = np.empty((rows_total, n, m))
        mae, mse = np.empty((rows_total, n)), np.empty((rows_total, n))
        for every, truths in by_length(y_true):
            most = max(1, PIECE_BYTES // (8 * truths.shape[1] * (m + 3 * n)))
            for at in range(0, len(every), most):
                rows, true = every[at : at + most], truths[at : at + most]
                part = y_preds.take(pa.array(rows)).flatten()
                preds = np.asarray(part.flatten(), dtype=float).reshape(len(rows), m, -1)
                cal[rows], mae[rows], mse[rows] = _sweep_batch(w_all[rows], preds, true, grid)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(rows_total * n + 1, dtype=np.int32) * m), pa.array(cal.ravel()))
        structs = pa.StructArray.from_arrays([flat, pa.array(mae.ravel()), pa.array(mse.ravel())], names=["weights", "mae", "mse"])
        return pa.ListArray.from_arrays(pa.array(np.arange(rows_total + 1, dtype=np.int32) * n), structs)

    return run


def sweep(
    routed: DataFrame, forecasts: DataFrame, experts: Sequence[str], metric: str, grid: Sequence[Strategy] | None = None
) -> DataFrame:
    """Every strategy on every routed test row.

    Arrays are stacked once per sample; all strategies of a sample are computed in
    one Arrow batch (about 20 weight sets times the horizon, far from what interpreted
    array lambdas do well) and opened afterwards, so neither the shuffle nor the batch
    copies the arrays per strategy.
    """
    wanted = forecasts.join(routed.select("sample_key"), "sample_key", "left_semi")
    slim = routed.select("router_name", *STABLE, "oracle_model", "oracle_value", *[f"weight_{e}" for e in experts])
    return swept_rows(strict_join(slim, stack_experts(wanted, experts), ["sample_key"]), experts, metric, grid)


def swept_rows(rows: DataFrame, experts: Sequence[str], metric: str, grid: Sequence[Strategy] | None = None) -> DataFrame:
    """:func:`sweep` of routed rows that hold ``y_true`` and ``y_preds`` as well; without a shuffle."""
    m = len(experts)
    grid = list(grid or strategies())
    j = rows.select("router_name", *STABLE, "oracle_model", "oracle_value", weights_array(experts).alias("_original"), "y_preds", "y_true")
    done = j.withColumn("_all", _swept_errors(grid)("_original", "y_preds", "y_true")).drop("y_preds", "y_true")
    # no list is empty; "outer" keeps Spark from a filter on them, for which the function would be evaluated once more
    opened = done.select("*", F.posexplode_outer("_all").alias("_i", "_e")).drop("_all").withColumn("_s", F.get(F.array(*[_strategy_struct(s) for s in grid]), F.col("_i")))
    columns = [F.col(f"_s.{c}") for c in ("strategy_name", "strategy_family", "temperature", "top_k")] + [F.col(f"_e.{c}") for c in ("weights", "mae", "mse")]
    scored = weight_stats(opened.select("*", *columns).drop("_i", "_e", "_s"), experts)
    value = F.col(metric)
    return scored.select(
        "strategy_name",
        "strategy_family",
        "temperature",
        "top_k",
        "router_name",
        *STABLE,
        "selected_model",
        value.alias("selected_value"),
        "mae",
        "mse",
        "oracle_model",
        "oracle_value",
        (value - F.col("oracle_value")).alias("regret_to_oracle"),
        (F.col("selected_model") == F.col("oracle_model")).alias("oracle_label_correct"),
        "weight_entropy",
        "normalized_weight_entropy",
        "max_weight",
        "active_weight_count",
        "active_models",
        *[F.element_at("weights", i + 1).alias(f"calibrated_weight_{e}") for i, e in enumerate(experts)],
        *[F.element_at("_original", i + 1).alias(f"original_weight_{e}") for i, e in enumerate(experts)],
    )


SWEEP_KEYS = ["strategy_name", "strategy_family", "config_name", "temperature", "top_k"]


def summarize_sweep(swept: DataFrame, metric: str) -> DataFrame:
    """Per strategy and config, ranked by the metric inside the config."""
    g = swept.groupBy(*SWEEP_KEYS).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(metric).alias("selected_value"),
        F.avg("mae").alias("mae"),
        F.avg("mse").alias("mse"),
        F.avg("oracle_value").alias("oracle_value"),
        F.avg("regret_to_oracle").alias("regret_to_oracle"),
        F.avg(F.col("oracle_label_correct").cast("double")).alias("oracle_label_accuracy"),
        F.avg("weight_entropy").alias("mean_weight_entropy"),
        F.avg("normalized_weight_entropy").alias("mean_normalized_weight_entropy"),
        F.avg("max_weight").alias("mean_max_weight"),
        F.avg("active_weight_count").alias("mean_active_weight_count"),
    )
    return g.orderBy("config_name", "selected_value", "strategy_name")


def check_weights(routed: DataFrame, experts: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """One row per check of a weight table: key, split, finite values, row sums.

    Missing columns are reported from the schema without a job.
    """
    missing = [e for e in experts if f"weight_{e}" not in routed.columns]
    if missing:
        return routed.sparkSession.createDataFrame([("missing_columns", len(missing), False)], "check string, violations long, passed boolean")
    w = weights_array(experts)
    finite = F.forall(w, lambda v: F.coalesce(is_finite(v), F.lit(False)))
    per_key = routed.groupBy("router_name", "sample_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("split") != "test").alias("_split"),
        F.count_if(~finite).alias("_finite"),
        F.count_if(finite & (F.abs(asum(w) - 1.0) > tolerance)).alias("_sum"),
    )
    wide = per_key.agg(
        F.lit(0).alias("missing_columns"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_key"),
        F.sum("_split").alias("not_test"),
        F.sum("_finite").alias("non_finite"),
        F.sum("_sum").alias("row_sum"),
    )
    return as_checks(wide)


def soft_oracle(df: DataFrame, tau: float, experts: Sequence[str], out: str = "soft_oracle") -> DataFrame:
    """``softmax(-error / tau)`` over the expert error columns."""
    return df.withColumn(out, softmax(F.array(*[-F.col(e) / F.lit(float(tau)) for e in experts])))


def huber(e: Column, beta: float) -> Column:
    """SmoothL1 of one residual."""
    a = F.abs(e)
    return F.when(a < beta, a * a * (0.5 / beta)).otherwise(a - 0.5 * beta)


def fusion_loss(df: DataFrame, beta: float, tau: float, lam: float, experts: Sequence[str]) -> DataFrame:
    """Mean SmoothL1, mean KL(q || p) and ``huber + lam * kl`` per config.

    Rows carry ``y_true``, ``y_preds``, ``weights`` and the expert error columns.
    """
    fused = fuse(F.col("y_preds"), F.col("weights"), len(experts))
    losses = F.zip_with(fused, F.col("y_true"), lambda p, y: huber(p - y, beta))
    q = soft_oracle(df, tau, experts, "_q")
    kl = asum(
        F.zip_with(
            F.col("_q"),
            F.col("weights"),
            lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(F.lit(0.0)),
        )
    )
    rows = q.select("config_name", asum(losses).alias("_h"), F.size("y_true").alias("_n"), kl.alias("_kl"))
    g = rows.groupBy("config_name").agg(
        F.count(F.lit(1)).alias("sample_count"),
        ratio(F.sum("_h"), F.sum("_n")).alias("huber_loss"),
        F.avg("_kl").alias("kl_loss"),
    )
    return g.withColumn("total_loss", F.col("huber_loss") + lam * F.col("kl_loss"))
