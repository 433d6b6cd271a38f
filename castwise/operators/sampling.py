"""Sampling and sharding of items and windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castwise.functions.columns import sample_key
from castwise.operators.joins import enrich
from castwise.operators.ordering import first_per_group, with_rank, with_running_total
from castwise.schemas import SERIES
from castwise.session import written

# Fixed values of the size estimate: bytes per value, file header and least file size.
VALUE_BYTES = 4
ARRAY_HEADER_BYTES = 128
ARRAY_MIN_BYTES = 320
MIB = 1024.0 * 1024.0


def _is_center(rank: Column, n: Column, count: Column) -> Column:
    """Whether a 0-based rank is one of ``floor((k + 0.5) * n / count)``, in whole numbers.

    The only candidate is the smallest k whose position reaches the rank.
    """
    k = F.floor((2 * count * rank + n - 1) / (2 * n))
    return (k < count) & (F.floor((2 * k + 1) * n / (2 * count)) == rank)


def _enough(n: Column, count: Column, what: str) -> Column:
    return F.when(count <= n, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"more {what} asked for than there are: "), count.cast("string"))).cast("boolean")
    )


def center_positions(n: Column, count: Column) -> Column:
    """Array of the ``count`` center-spaced positions in ``[0, n)``."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.floor((2 * k + 1) * n / (2 * count)).cast("int"))


def center_spaced(df: DataFrame, partition: Sequence[str], order: Sequence[str], count: int | str) -> DataFrame:
    """Rows at center-spaced ranks of each group; ``count`` may be a column name."""
    c = F.col(count) if isinstance(count, str) else F.lit(count)
    if not partition:
        return center_spaced(df.withColumn("_all", F.lit(0)), ["_all"], order, count).drop("_all")
    ranked = with_rank(df, order, partition, "_rank")
    sizes = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(sizes, list(partition))
    keep = (c > 0) & _enough(F.col("_n"), c, "rows") & _is_center(F.col("_rank"), F.col("_n"), c)
    return joined.filter(keep).select(*df.columns)


def sample_items_even(df: DataFrame, count: int, partition: Sequence[str] = ("split", "dataset_name")) -> DataFrame:
    """Center-spaced items over the sorted distinct item ids."""
    items = df.select(*partition, "item_id").distinct()
    return center_spaced(items, partition, ["item_id"], count)


def balanced_quotas(sizes: DataFrame, total: int, partition: Sequence[str], group: str = "group_name") -> DataFrame:
    """Even quotas over groups with capacities (columns: partition, group, ``size``).

    Handing out one place at a time to the least-filled group (names break ties)
    ends with every group at ``min(size, level)``, and the first open groups by
    name one higher.  ``level`` follows from prefix sums over the sorted sizes, so
    only group rows (not items) are windowed.
    """
    by_size = W.partitionBy(*partition).orderBy("size", group)
    whole = W.partitionBy(*partition)
    t = F.lit(total)
    s = (
        sizes.filter("size > 0")
        .withColumn("_all", F.sum("size").over(whole))
        .filter(F.when(F.col("_all") >= t, True).otherwise(F.raise_error(F.lit("fewer items than asked for")).cast("boolean")))
        .withColumn("_below", F.sum("size").over(by_size.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
        .withColumn("_left", F.count(F.lit(1)).over(whole) - F.row_number().over(by_size) + 1)
    )
    # The first group that would not be filled fixes the level.
    enough = F.col("_below") + F.col("_left") * F.col("size") >= t
    s = s.withColumn("_stop", F.min(F.when(enough, F.struct("size", group, "_below", "_left"))).over(whole))
    s = s.withColumn("_level", F.floor((t - F.col("_stop._below")) / F.col("_stop._left"))).withColumn(
        "_rest", t - F.col("_stop._below") - F.col("_level") * F.col("_stop._left")
    )
    is_open = F.col("size") > F.col("_level")
    nth = F.sum(is_open.cast("int")).over(W.partitionBy(*partition).orderBy(group).rowsBetween(W.unboundedPreceding, W.currentRow))
    extra = F.when(is_open & (nth <= F.col("_rest")), 1).otherwise(0)
    return s.select(*partition, group, "size", (F.least("size", "_level") + extra).cast("long").alias("quota"))


def sample_items_balanced(
    items: DataFrame, regimes: DataFrame, count: int, partition: Sequence[str] = ("split", "dataset_name")
) -> DataFrame:
    """Regime-balanced items: balanced quotas per cell, then center-spaced inside each cell."""
    mapped = enrich(items.select(*partition, "item_id").distinct(), regimes.select("item_id", "group_name"))
    sizes = mapped.groupBy(*partition, "group_name").agg(F.count(F.lit(1)).alias("size"))
    quotas = balanced_quotas(sizes, count, partition).filter("quota > 0").select(*partition, "group_name", "quota")
    pool = mapped.join(quotas, [*partition, "group_name"])
    return center_spaced(pool, [*partition, "group_name"], ["item_id"], "quota").drop("quota")


def cap_channels(df: DataFrame, n: int, partition: Sequence[str] = ("split", "dataset_name")) -> DataFrame:
    """First ``n`` channels of each item; an item with fewer fails the job.

    Works on the distinct (item, channel) rows, then keeps matching rows by semi join.
    """
    keys = [*partition, "item_id", "channel_id"]
    channels = df.select(*keys).distinct()
    counts = channels.groupBy(*partition, "item_id").agg(F.count(F.lit(1)).alias("_n"))
    first = first_per_group(channels, [*partition, "item_id"], ["channel_id"], n).join(counts, [*partition, "item_id"])
    return df.join(first.filter(_enough(F.col("_n"), F.lit(n), "channels")), keys, "left_semi")


def head_items(df: DataFrame, n: int, partition: Sequence[str] = ("split", "dataset_name")) -> DataFrame:
    """Rows of the first ``n`` items (by id) of each partition."""
    items = first_per_group(df.select(*partition, "item_id").distinct(), partition, ["item_id"], n)
    return df.join(items, [*partition, "item_id"], "left_semi")


def head_windows(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` windows of each channel."""
    return first_per_group(df, ["config_name", "split", *SERIES], ["window_index"], n)


def limit_per_split(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` samples of each (config, split) by key."""
    return first_per_group(df, ["config_name", "split"], ["sample_key"], n)


def shard_by_key_rank(df: DataFrame, n: int) -> DataFrame:
    """Shard = (rank by sample key) mod n; exact ranks without a single-task sort."""
    return with_rank(df, ["sample_key"], (), "_rank").withColumn("shard", F.pmod("_rank", F.lit(n)).cast("int")).drop("_rank")


def shard_by_key_hash(df: DataFrame, n: int) -> DataFrame:
    """Shard by key hash: balanced on average, no shuffle at all."""
    return df.withColumn("shard", F.pmod(F.xxhash64("sample_key"), F.lit(n)).cast("int"))


def shard_round_robin(windows: DataFrame, n: int, order: Sequence[str] = ("config_name", "split", *SERIES)) -> DataFrame:
    """Shard = global window ordinal mod n.

    The ordinal is the series' start (prefix sum over series, not windows) plus the
    window index.
    """
    counts = windows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    starts = with_running_total(counts, order, F.col("_n"), (), "_start").drop("_n")
    ordinal = F.col("_start") + F.col("window_index")
    return (
        windows.join(starts, list(order))
        .withColumn("shard", F.pmod(ordinal, F.lit(n)).cast("int"))
        .select(*windows.columns, "shard")
    )


@dataclass(frozen=True)
class SampleConfig:
    """Settings of a sampled manifest."""

    config_name: str
    history_length: int
    pred_length: int
    items: int
    windows: int
    channels: int = 1
    strategy: str = "tsf_balanced"  # or "even_spaced"


def build_samples(panel: DataFrame, regimes: DataFrame, cfg: SampleConfig) -> DataFrame:
    """Sampled manifest: items, then channels, then center-spaced windows, keyed and enriched.

    Window positions come from each series' length by arithmetic; the full window
    list is never made.
    """
    return samples_of_series(panel.groupBy("split", *SERIES).agg(F.count(F.lit(1)).alias("_steps")), regimes, cfg)


def samples_of_series(series: DataFrame, regimes: DataFrame, cfg: SampleConfig) -> DataFrame:
    """:func:`build_samples` of a table with the number of steps (``_steps``) of every series.

    The chosen items' series (a number that ``cfg`` fixes) are written once; all after that works on them.
    """
    width = cfg.history_length + cfg.pred_length
    series = series.select("split", *SERIES, (F.col("_steps") - (width - 1)).alias("_n")).filter("_n > 0")
    if cfg.strategy == "tsf_balanced":
        items = sample_items_balanced(series, regimes, cfg.items)
    else:
        items = sample_items_even(series, cfg.items)
    chosen = series.join(items.select("split", "dataset_name", "item_id"), ["split", "dataset_name", "item_id"], "left_semi")
    chosen = cap_channels(written(chosen, "chosen"), cfg.channels)
    positions = center_positions(F.col("_n"), F.lit(cfg.windows))
    rows = chosen.filter(_enough(F.col("_n"), F.lit(cfg.windows), "windows")).select(
        "split", *SERIES, F.explode(positions).alias("window_index")
    )
    keyed = (
        rows.withColumn("config_name", F.lit(cfg.config_name))
        .withColumn("history_length", F.lit(cfg.history_length))
        .withColumn("pred_length", F.lit(cfg.pred_length))
        .withColumn("selection_strategy", F.lit(cfg.strategy))
        .withColumn("sample_key", sample_key())
    )
    return enrich(keyed, regimes).select(
        "sample_key",
        "config_name",
        "split",
        *SERIES,
        "window_index",
        "history_length",
        "pred_length",
        "selection_strategy",
        *[c for c in regimes.columns if c != "item_id"],
    )


def estimate_cost(samples: DataFrame, n_experts: int, embedding_dim: int) -> DataFrame:
    """Rows and MiB per config if arrays and embeddings are stored."""
    one = F.greatest(F.lit(ARRAY_MIN_BYTES), F.col("pred_length") * VALUE_BYTES + ARRAY_HEADER_BYTES)
    n = F.col("sample_count").cast("double")
    return (
        samples.groupBy("config_name", "pred_length")
        .agg(F.count(F.lit(1)).alias("sample_count"))
        .select(
            "config_name",
            "sample_count",
            (F.col("sample_count") * n_experts).alias("forecast_rows"),
            (n * (n_experts * 2) * one / MIB).alias("own_truth_mib"),
            (n * (n_experts + 1) * one / MIB).alias("shared_truth_mib"),
            (n * (embedding_dim * 4) / MIB).alias("embedding_float32_mib"),
            (n * (embedding_dim * 2) / MIB).alias("embedding_float16_mib"),
        )
    )
