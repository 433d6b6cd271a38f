"""Rule routing and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castwise.functions.columns import argmax_name, argmin_name, pick, ratio
from castwise.operators.joins import relative_to
from castwise.operators.oracle import level_name
from castwise.session import lookup_table, written


@dataclass(frozen=True)
class Rule:
    """A group -> expert rule; ``kind`` is mean_metric_best or majority_label."""

    name: str
    group: tuple[str, ...] = ()
    kind: str = "mean_metric_best"


# The eight rules of the baseline suite.
RULES = [
    Rule("global_best_single"),
    Rule("dataset_only", ("dataset_name",)),
    Rule("tsf_cell_only", ("group_name",)),
    Rule("dataset_tsf_cell", ("dataset_name", "group_name")),
    Rule("global_majority_label", (), "majority_label"),
    Rule("dataset_majority_label", ("dataset_name",), "majority_label"),
    Rule("tsf_cell_majority_label", ("group_name",), "majority_label"),
    Rule("dataset_tsf_cell_majority_label", ("dataset_name", "group_name"), "majority_label"),
]
GLOBAL = "global_best_single"
ORACLE = "oracle_top1"

# Means that agree to this many digits are equal; the earlier expert wins.
MEAN_DIGITS = 12

ROUTED = ["sample_key", "config_name", "split", "dataset_name", "item_id", "channel_id", "window_index"]


def _choices(experts: Sequence[str]) -> list[Column]:
    """Aggregates a rule needs: mean error and oracle wins per expert."""
    means = [F.avg(e).alias(f"_m_{e}") for e in experts]
    wins = [F.count_if(F.col("oracle_model") == e).alias(f"_w_{e}") for e in experts]
    return means + wins


def _mean_best(experts: Sequence[str]) -> Column:
    return argmin_name([F.round(f"_m_{e}", MEAN_DIGITS) for e in experts], experts)


def _majority(experts: Sequence[str]) -> Column:
    return argmax_name([F.col(f"_w_{e}") for e in experts], experts)


def fit_rule(labels: DataFrame, group: Sequence[str], kind: str, experts: Sequence[str]) -> DataFrame:
    """Expert chosen on vali per config and group: lowest mean error, or most oracle wins."""
    choice = _mean_best(experts) if kind == "mean_metric_best" else _majority(experts)
    vali = labels.filter(F.col("split") == "vali")
    return vali.groupBy("config_name", *group).agg(*_choices(experts)).select(
        "config_name", *group, choice.alias("selected_model")
    )


def _lookup(df: DataFrame, rule: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Null-safe left join of rule columns; the rule table is written once and broadcast if it is small."""
    keys = ["config_name", *group]
    right = lookup_table(rule, "rule").select(*[F.col(k).alias(f"_r_{k}") for k in keys], *cols)
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return df.join(right, match, "left").drop(*[f"_r_{k}" for k in keys])


def _judge(df: DataFrame, experts: Sequence[str]) -> DataFrame:
    value = pick(F.col("selected_model"), experts, [F.col(e) for e in experts])
    return (
        df.withColumn("selected_value", value)
        .withColumn("regret_to_oracle", F.col("selected_value") - F.col("oracle_value"))
        .withColumn("oracle_label_correct", F.col("selected_model") == F.col("oracle_model"))
    )


def apply_rule(
    labels: DataFrame, rule: DataFrame, group: Sequence[str], fallback: DataFrame, experts: Sequence[str]
) -> DataFrame:
    """Score a rule on test; a group unseen on vali takes the config's global mean-best expert."""
    test = labels.filter(F.col("split") == "test")
    hit = _lookup(test, rule.withColumnRenamed("selected_model", "_hit"), group, ["_hit"])
    both = _lookup(hit, fallback.withColumnRenamed("selected_model", "_fallback"), [], ["_fallback"])
    chosen = both.withColumn("selected_model", F.coalesce("_hit", "_fallback")).drop("_hit", "_fallback")
    return _judge(chosen, experts)


def fit_suite(labels: DataFrame, experts: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rules of the suite from one GROUPING SETS pass over vali.

    ``_level`` tells the grouping; ``_mean`` and ``_major`` are the two choices.
    """
    groups = list(dict.fromkeys(r.group for r in rules))
    if () not in groups:
        groups.insert(0, ())
    cols = ["config_name", *dict.fromkeys(c for g in groups for c in g)]
    sets = [[F.col(c) for c in ("config_name", *g)] for g in groups]
    vali = labels.filter(F.col("split") == "vali")
    return vali.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.grouping_id().alias("_gid"), *_choices(experts)).select(
        level_name(F.col("_gid"), cols).alias("_level"),
        *cols,
        _mean_best(experts).alias("_mean"),
        _majority(experts).alias("_major"),
    )


def baseline_suite(labels: DataFrame, experts: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every rule, and the oracle, on every test row (one metric's labels with regime columns).

    The rules are fitted first and written (one row per group), so that the lookups
    below do not fit them again for every grouping.  The test rows are then read once:
    each grouping adds its two choices by a lookup, and all rules are opened from one
    array of (name, kind, expert) structs.
    """
    fitted = written(fit_suite(labels, experts, rules), "rules")
    rows = labels.filter(F.col("split") == "test")
    groups = list(dict.fromkeys([(), *[r.group for r in rules]]))
    for i, g in enumerate(groups):
        part = fitted.filter(F.col("_level") == ",".join(("config_name", *g)))
        part = part.withColumnRenamed("_mean", f"_mean{i}").withColumnRenamed("_major", f"_major{i}")
        rows = _lookup(rows, part, g, [f"_mean{i}", f"_major{i}"])
    structs = []
    for r in rules:
        i = groups.index(r.group)
        hit = f"_mean{i}" if r.kind == "mean_metric_best" else f"_major{i}"
        structs.append(_named(r.name, r.kind, F.coalesce(F.col(hit), F.col("_mean0"))))
    structs.append(_named(ORACLE, "upper_bound", F.col("oracle_model")))
    regime = [c for c in ("cluster", "group_name") if c in labels.columns]
    keep = [*ROUTED, *regime, "oracle_model", "oracle_value", *experts]
    opened = rows.select(*keep, F.inline(F.array(*structs)))
    return _judge(opened, experts).select(
        "baseline",
        "rule_kind",
        *ROUTED,
        *regime,
        "selected_model",
        "selected_value",
        "oracle_model",
        "oracle_value",
        "regret_to_oracle",
        "oracle_label_correct",
    )


def _named(name: str, kind: str, model: Column) -> Column:
    return F.struct(F.lit(name).alias("baseline"), F.lit(kind).alias("rule_kind"), model.alias("selected_model"))


def _route_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("selected_value").alias("selected_value"),
        F.avg("oracle_value").alias("oracle_value"),
        F.avg("regret_to_oracle").alias("regret_to_oracle"),
        F.avg(F.col("oracle_label_correct").cast("double")).alias("oracle_label_accuracy"),
    ]


def summarize_routing(predictions: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Summaries at several levels in one pass, each compared with the global best single there."""
    cols = list(dict.fromkeys(c for level in levels for c in level))
    base = ["baseline", "rule_kind"]
    sets = [[F.col(c) for c in (*base, *level)] for level in levels]
    agg = predictions.groupingSets(sets, *[F.col(c) for c in (*base, *cols)]).agg(
        F.grouping_id().alias("_gid"), *_route_measures()
    )
    named = agg.withColumn("level", level_name(F.col("_gid"), [*base, *cols])).withColumn(
        "level", F.expr(f"substring(level, {len(','.join(base)) + 2})")
    ).drop("_gid")
    # Summary rows only: one row per rule and group.
    same_group = W.partitionBy("level", *cols)
    reference = F.max(F.when(F.col("baseline") == GLOBAL, F.col("selected_value"))).over(same_group)
    gain = ratio(reference - F.col("selected_value"), reference)
    return named.withColumn("relative_improvement_vs_global", gain).select(
        "level",
        *base,
        *cols,
        "sample_count",
        "selected_value",
        "oracle_value",
        "regret_to_oracle",
        "oracle_label_accuracy",
        "relative_improvement_vs_global",
    )


def macro_summary(by_config: DataFrame) -> DataFrame:
    """Average of config-level summaries, each config counting once."""
    measures = [
        "sample_count",
        "selected_value",
        "oracle_value",
        "regret_to_oracle",
        "oracle_label_accuracy",
        "relative_improvement_vs_global",
    ]
    return by_config.groupBy("baseline", "rule_kind").agg(
        F.countDistinct("config_name").alias("config_count"), *[F.avg(m).alias(m) for m in measures]
    )


def summarize_hard(routed: DataFrame) -> DataFrame:
    """Hard top-1 measures and weight diagnostics per router and config."""
    return routed.groupBy("router_name", "config_name").agg(
        *_route_measures(),
        F.avg("weight_entropy").alias("mean_weight_entropy"),
        F.avg("normalized_weight_entropy").alias("mean_normalized_weight_entropy"),
        F.avg("max_weight").alias("mean_max_weight"),
    )


def selection_counts(routed: DataFrame, group: Sequence[str], experts: Sequence[str]) -> DataFrame:
    """How often each expert is picked per group, unpicked experts included.

    All experts are counted as columns in one aggregation and opened afterwards.
    """
    wide = routed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("selected_model") == e).alias(e) for e in experts]
    )
    return wide.unpivot([*group, "_n"], list(experts), "selected_model", "count").select(
        *group, "selected_model", "count", ratio(F.col("count"), F.col("_n")).alias("ratio")
    )


METHOD_COLUMNS = [
    "method",
    "method_family",
    "config_name",
    "sample_count",
    "mae_like_value",
    "oracle_value",
    "regret_to_oracle",
    "oracle_label_accuracy",
    "mean_weight_entropy",
    "mean_normalized_weight_entropy",
    "mean_max_weight",
    "source",
]


def methods_from_rules(summary: DataFrame, source: str = "baseline_summary") -> DataFrame:
    return summary.select(
        F.col("baseline").alias("method"),
        F.col("rule_kind").alias("method_family"),
        "config_name",
        "sample_count",
        F.col("selected_value").alias("mae_like_value"),
        "oracle_value",
        "regret_to_oracle",
        "oracle_label_accuracy",
        F.lit(source).alias("source"),
    )


def methods_from_hard(summary: DataFrame, family: str, source: str) -> DataFrame:
    return summary.withColumnsRenamed({"router_name": "method", "selected_value": "mae_like_value"}).select(
        "*", F.lit(family).alias("method_family"), F.lit(source).alias("source")
    )


def methods_from_soft(summary: DataFrame, metric: str, family: str, source: str) -> DataFrame:
    value = F.col(f"soft_fusion_{metric}")
    return summary.select(
        F.col("router_name").alias("method"),
        F.lit(family).alias("method_family"),
        "config_name",
        "sample_count",
        value.alias("mae_like_value"),
        "oracle_value",
        (value - F.col("oracle_value")).alias("regret_to_oracle"),
        "mean_weight_entropy",
        "mean_normalized_weight_entropy",
        "mean_max_weight",
        F.lit(source).alias("source"),
    )


def methods_from_sweep(summary: DataFrame, source: str) -> DataFrame:
    return summary.withColumnsRenamed(
        {"strategy_name": "method", "strategy_family": "method_family", "selected_value": "mae_like_value"}
    ).select("*", F.lit(source).alias("source"))


def compare_methods(*summaries: DataFrame) -> DataFrame:
    """One table over all methods with the gain over the global best single of the config."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    union = union.select(*[c for c in METHOD_COLUMNS if c in union.columns])
    gain = "relative_improvement_vs_global_best_single"
    return relative_to(union, GLOBAL, ["config_name"], "method", "mae_like_value", gain).orderBy(
        "config_name", "mae_like_value", "method"
    )


def compare_runs(df: DataFrame, base_run: str, value: str = "mae_like_value") -> DataFrame:
    """Difference of each run's value from the same method and config in ``base_run``."""
    base = df.filter(F.col("run") == base_run).select("method", "config_name", F.col(value).alias("base_value"))
    return df.join(base, ["method", "config_name"], "left").withColumn("delta", F.col(value) - F.col("base_value"))


def best_method(comparison: DataFrame) -> DataFrame:
    """Best fixed method per config, the oracle left out; equal means go by name."""
    w = W.partitionBy("config_name").orderBy(F.round("mae_like_value", MEAN_DIGITS), "method")
    fair = comparison.filter(F.col("method") != ORACLE)
    return fair.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def leave_one_group_out(labels: DataFrame, group: str, experts: Sequence[str]) -> DataFrame:
    """Fit the mean-best expert on all groups but one (vali) and test on that group (test), for each group.

    Uses sums: everything minus the held-out group, so vali is read once however
    many groups there are.
    """
    sums = [F.sum(e).alias(f"_s_{e}") for e in experts]
    vali = labels.filter(F.col("split") == "vali").groupBy("config_name", group).agg(F.count(F.lit(1)).alias("_n"), *sums)
    whole = W.partitionBy("config_name")
    others = vali.select(
        "config_name",
        group,
        (F.sum("_n").over(whole) - F.col("_n")).alias("_no"),
        *[(F.sum(f"_s_{e}").over(whole) - F.col(f"_s_{e}")).alias(f"_o_{e}") for e in experts],
    ).filter("_no > 0")
    means = [F.round(ratio(F.col(f"_o_{e}"), F.col("_no")), 9) for e in experts]
    rule = others.select("config_name", group, argmin_name(means, experts).alias("selected_model"))
    # A group absent from vali takes nothing away: its rule is fitted on all of vali.
    whole_rule = fit_rule(labels, [], "mean_metric_best", experts)
    scored = apply_rule(labels, rule, [group], whole_rule, experts)
    return scored.groupBy("config_name", group, "selected_model").agg(*_route_measures())
