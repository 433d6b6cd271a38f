"""Joins between samples, labels, features, forecasts and regimes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castwise.functions.columns import ratio
from castwise.schemas import REGIME, STABLE


def strict_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = STABLE) -> DataFrame:
    """1:1 join on the stable columns; a row without a partner or with two fails the job.

    The sample key names the sample alone, so rows meet on it and their other columns are compared after
    that: all joins and groupings of samples share one partitioning.

    One full outer join carries the check along. The rows of a key are counted where the join
    sorts them, so no extra shuffle is needed.
    """
    on = ["sample_key"] if "sample_key" in keys else list(keys)
    rest = [k for k in keys if k not in on]
    per_key = W.partitionBy(*on)
    left = a.withColumn("_a", F.count(F.lit(1)).over(per_key))
    right = b.withColumn("_b", F.count(F.lit(1)).over(per_key)).withColumnsRenamed({k: f"_r_{k}" for k in rest})
    both = (F.col("_a") == 1) & (F.col("_b") == 1)
    for k in rest:
        both = both & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    first = on[0]
    joined = left.join(right, on, "full_outer")
    key = F.when(both, F.col(first)).otherwise(
        F.raise_error(F.concat(F.lit("not one partner in strict join: "), F.col(first).cast("string"))).cast(
            joined.schema[first].dataType
        )
    )
    return joined.withColumn(first, key).filter(F.col(first).isNotNull()).drop("_a", "_b", *[f"_r_{k}" for k in rest])


def stored_strict_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = STABLE) -> DataFrame:
    """:func:`strict_join` for stored tables bucketed alike on the sample key: neither side is shuffled, and the result keeps the buckets.

    A full outer join would lose them, so this is a left join that fails on rows of ``a`` without exactly one partner;
    add :func:`no_others` to the end result for rows of ``b`` that ``a`` lacks.
    """
    on = ["sample_key"] if "sample_key" in keys else list(keys)
    rest = [k for k in keys if k not in on]
    per_key = W.partitionBy(*on)
    left = a.withColumn("_a", F.count(F.lit(1)).over(per_key))
    right = b.withColumn("_b", F.count(F.lit(1)).over(per_key)).withColumnsRenamed({k: f"_r_{k}" for k in rest})
    both = (F.col("_a") == 1) & F.coalesce(F.col("_b") == 1, F.lit(False))
    for k in rest:
        both = both & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    said = F.concat(F.lit("not one partner in strict join: "), F.col(on[0]).cast("string"))
    joined = left.join(right, on, "left").filter(F.when(both, True).otherwise(F.raise_error(said).cast("boolean")))
    return joined.drop("_a", "_b", *[f"_r_{k}" for k in rest])


def no_others(result: DataFrame, b: DataFrame, a: DataFrame, key: str = "sample_key") -> DataFrame:
    """``result``, failing when ``b`` has a key that ``a`` lacks. Reads the keys of both once more, in their buckets."""
    others = b.select(key).join(a.select(key), key, "left_anti")
    said = F.concat(F.lit("not one partner in strict join: "), F.col(key).cast("string"))
    kinds = {f.name: f.dataType for f in result.schema}
    nothing = [(F.raise_error(said) if c == key else F.lit(None)).cast(kinds[c]).alias(c) for c in result.columns]
    return result.unionByName(others.select(*nothing))


def strict_join_report(a: DataFrame, b: DataFrame, keys: Sequence[str] = STABLE) -> DataFrame:
    """Rows matched and rows missing a partner on either side, in one pass."""
    left = a.select(*keys).withColumn("_a", F.lit(1))
    right = b.select(*keys).withColumn("_b", F.lit(1))
    has_a, has_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return left.join(right, list(keys), "full_outer").agg(
        F.count_if(has_a & has_b).alias("matched"),
        F.count_if(has_a & ~has_b).alias("left_only"),
        F.count_if(has_b & ~has_a).alias("right_only"),
    )


def enrich(df: DataFrame, regimes: DataFrame, on: str = "item_id", missing: str = "error") -> DataFrame:
    """Left join on item; replaces stale regime columns; an unmapped item fails the job.

    The regime table grows with the number of items, so no broadcast is forced:
    Spark broadcasts it only while it is below the size threshold, and a hot item
    in a sort-merge join is split by AQE.
    """
    new = [c for c in regimes.columns if c != on]
    base = df.drop(*[c for c in [*REGIME, *new] if c in df.columns])
    out = base.join(regimes.withColumn("_hit", F.lit(1)), on, "left")
    if missing == "error":
        checked = F.when(F.col("_hit").isNotNull(), F.col(new[0])).otherwise(
            F.raise_error(F.concat(F.lit(f"no regime for {on} "), F.col(on).cast("string"))).cast(
                regimes.schema[new[0]].dataType
            )
        )
        out = out.withColumn(new[0], checked)
    return out.select(*base.columns, *new)


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count and rate of each column."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot(["_n"], list(cols), "field", "missing_count").select(
        "field", "missing_count", F.coalesce(ratio(F.col("missing_count"), F.col("_n")), F.lit(0.0)).alias("missing_rate")
    )


def key_diff(a: DataFrame, b: DataFrame, key: str = "sample_key") -> DataFrame:
    """Keys present on one side only (``side`` is left or right); a null key has no partner.

    Both sides meet in one aggregation of keys and two flags.
    """
    sides = a.select(key, F.lit(True).alias("_l"), F.lit(False).alias("_r")).union(b.select(key, F.lit(False), F.lit(True)))
    seen = sides.groupBy(key).agg(F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))
    alone = F.col(key).isNull()
    only = F.array(
        F.when(F.col("_l") & (~F.col("_r") | alone), F.lit("left")), F.when(F.col("_r") & (~F.col("_l") | alone), F.lit("right"))
    )
    return seen.select(key, F.explode(F.array_compact(only)).alias("side"))


def restrict_keys(df: DataFrame, keys: DataFrame, key: str = "sample_key") -> DataFrame:
    """Rows whose key is in ``keys`` (semi join)."""
    return df.join(keys.select(key), key, "left_semi")


def relative_to(df: DataFrame, baseline: str, group: Sequence[str], method: str, value: str, out: str) -> DataFrame:
    """Gain over the baseline row of the same group: ``(base - value) / base``.

    Summary tables have one row per method and group; the baseline row is looked
    up by a null-safe self join.
    """
    if not group:
        whole = df.withColumn("_all", F.lit(0))
        return relative_to(whole, baseline, ["_all"], method, value, out).drop("_all")
    base = df.filter(F.col(method) == baseline).select(
        *[F.col(g).alias(f"_b_{g}") for g in group], F.col(value).alias("_base")
    )
    match = reduce(lambda a, b: a & b, [df[g].eqNullSafe(base[f"_b_{g}"]) for g in group])
    joined = df.join(base, match, "left")
    return joined.withColumn(out, ratio(F.col("_base") - F.col(value), F.col("_base"))).select(*df.columns, out)


def sample_join(labels: DataFrame, enriched: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of each side in key order, joined on the sample key (a spot check table)."""
    left = labels.orderBy("sample_key", "metric").limit(n)
    right = enriched.orderBy("sample_key").limit(n)
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select("sample_key", *extra), "sample_key")


def stack_experts(forecasts: DataFrame, experts: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """One row per sample: ``y_true`` and ``y_preds`` in expert order, and ``values`` as ``<value>_by_expert``.

    Collects at most one row per expert and sample.  A missing expert, a repeated
    one or a differing truth fails the job.
    """
    order = F.array_position(F.array(*[F.lit(e) for e in experts]), F.col("model_name"))
    rows = forecasts.filter(F.col("model_name").isin(list(experts)))
    g = rows.groupBy("sample_key").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("y_pred"), F.col("y_true"), *[F.col(v) for v in values]))).alias("_p")
    )
    expected = F.array(*[F.lit(i + 1).cast("long") for i in range(len(experts))])
    complete = F.transform("_p", lambda s: s["o"]) == expected
    shared = F.forall("_p", lambda s: s["y_true"] == F.element_at("_p", 1)["y_true"])
    y_preds = F.when(complete & shared, F.transform("_p", lambda s: s["y_pred"])).otherwise(
        F.raise_error(F.concat(F.lit("experts or truth do not fit: "), F.col("sample_key"))).cast("array<array<double>>")
    )
    more = [F.col(f"_p.{v}").alias(f"{v}_by_expert") for v in values]
    return g.select("sample_key", F.element_at("_p", 1)["y_true"].alias("y_true"), y_preds.alias("y_preds"), *more)


def fusion_input(
    features: DataFrame, labels: DataFrame, forecasts: DataFrame, experts: Sequence[str], feature_cols: Sequence[str], bucketed: bool = False
) -> DataFrame:
    """Features x label x all expert arrays, one wide row per sample.

    ``errors`` and ``y_preds`` are arrays in expert order, so expert names never meet
    feature names. With ``bucketed``, all three are tables bucketed alike on the sample key and nothing is shuffled.
    """
    lab = labels.select(*STABLE, "oracle_model", "oracle_value", F.array(*[F.col(e) for e in experts]).alias("errors"))
    slim = features.select(*STABLE, *feature_cols)
    stacked = stack_experts(forecasts, experts)
    if not bucketed:
        return strict_join(strict_join(slim, lab), stacked, ["sample_key"])
    joined = stored_strict_join(stored_strict_join(slim, lab), stacked, ["sample_key"])
    known = forecasts.filter(F.col("model_name").isin(list(experts)))
    return no_others(no_others(joined, labels, features), known, features)
