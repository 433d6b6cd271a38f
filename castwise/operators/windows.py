"""Sliding windows over a dense panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise.functions.columns import sample_key
from castwise.schemas import SERIES

BLOCK = 1024


def enumerate_windows(panel: DataFrame, history: int, future: int, block: int = BLOCK) -> DataFrame:
    """All stride-1 windows of every (series, split): ``window_index`` in ``[0, T-L-H]``.

    The range is opened in two steps (blocks, then windows inside a block) with a
    shuffle between, so that one very long series does not fill a single task.
    """
    counts = panel.groupBy("split", *SERIES).agg((F.count(F.lit(1)) - (history + future) + 1).alias("_n"))
    blocks = (
        counts.filter("_n > 0")
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {block}"))))
        .repartition("split", *SERIES, "_b")
    )
    last = F.least(F.col("_n") - 1, F.col("_b") * block + (block - 1))
    opened = blocks.select("split", *SERIES, F.explode(F.sequence(F.col("_b") * block, last)).alias("_w"))
    return opened.select("split", *SERIES, F.col("_w").cast("int").alias("window_index"))


def series_blocks(panel: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Bounded pieces of each series: ``block`` window starts plus the ``width - 1`` steps after them.

    Grouping on (series, block) instead of the series keeps every group below
    ``block + width`` steps however long a series is. The pieces take about the room of the panel, while its
    windows take ``width`` times that; windows of every smaller width can be cut from them as well.
    """
    block = max(block, width)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - (width - 1)) / block))
    pieces = panel.select(
        "split",
        *SERIES,
        "pos",
        "value",
        F.explode(F.sequence(first.cast("int"), F.floor(F.col("pos") / block).cast("int"))).alias("_b"),
    )
    grouped = pieces.groupBy("split", *SERIES, "_b").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_a"))
    return grouped.select(
        "split",
        *SERIES,
        "_b",
        (F.col("_b") * block + (block - 1)).alias("_last"),
        F.col("_a.pos").alias("_p"),
        F.col("_a.value").alias("_v"),
    )


def _open(blocks: DataFrame, width: int) -> DataFrame:
    """One row per full window of ``width`` steps: its block's values and its first place (from 1) in them."""
    starts = blocks.filter(F.size("_p") >= width).select(
        "split", *SERIES, "_last", "_p", "_v", F.explode(F.sequence(F.lit(1), F.size("_p") - (width - 1))).alias("_o")
    )
    first = F.element_at("_p", F.col("_o"))
    last = F.element_at("_p", F.col("_o") + (width - 1))
    return starts.filter((first <= F.col("_last")) & (last - first == width - 1)).select(
        "split", *SERIES, first.alias("window_index"), "_v", "_o"
    )


def with_history(panel: DataFrame, history: int, block: int = BLOCK) -> DataFrame:
    """History slice ``x = v[w : w+L]``; only full-length slices."""
    opened = _open(series_blocks(panel, history, block), history)
    return opened.withColumn("x", F.slice("_v", F.col("_o"), F.lit(history))).drop("_v", "_o")


def with_future(panel: DataFrame, history: int, future: int, block: int = BLOCK) -> DataFrame:
    """Future slice ``y_true = v[w+L : w+L+H]`` of every full window."""
    return cut_windows(panel, history, future, block).drop("x")


def cut_windows(panel: DataFrame, history: int, future: int, block: int = BLOCK) -> DataFrame:
    """History and future of every full window in one pass over the panel."""
    return open_blocks(series_blocks(panel, history + future, block), history, future)


def open_blocks(blocks: DataFrame, history: int, future: int) -> DataFrame:
    """:func:`cut_windows` from :func:`series_blocks` of this width or a larger one; without a shuffle."""
    return (
        _open(blocks, history + future)
        .withColumn("x", F.slice("_v", F.col("_o"), F.lit(history)))
        .withColumn("y_true", F.slice("_v", F.col("_o") + history, F.lit(future)))
        .drop("_v", "_o")
    )


def build_windows(panel: DataFrame, config_name: str, history: int, future: int, block: int = BLOCK) -> DataFrame:
    """The ``windows`` table of one config: sample columns, x and y_true."""
    return windows_table(cut_windows(panel, history, future, block), config_name, history, future)


def windows_table(cut: DataFrame, config_name: str, history: int, future: int) -> DataFrame:
    """The ``windows`` table of windows that are cut."""
    return as_samples(cut, config_name, history, future).select(
        "sample_key", "config_name", "split", *SERIES, "window_index", "history_length", "pred_length", "x", "y_true"
    )


def as_samples(windows: DataFrame, config_name: str, history: int, future: int) -> DataFrame:
    """Add config, lengths and the sample key to window rows."""
    return (
        windows.withColumn("config_name", F.lit(config_name))
        .withColumn("history_length", F.lit(history).cast("int"))
        .withColumn("pred_length", F.lit(future).cast("int"))
        .withColumn("sample_key", sample_key())
    )


def candidate_stats(panel: DataFrame, history: int, future: int) -> DataFrame:
    """Per split and dataset: items, series, windows per series and all windows."""
    series = panel.groupBy("split", *SERIES).agg(
        F.greatest(F.count(F.lit(1)) - (history + future) + 1, F.lit(0)).alias("_n")
    )
    return series.groupBy("split", "dataset_name").agg(
        F.countDistinct("item_id").alias("item_count"),
        F.count(F.lit(1)).alias("series_count"),
        F.max("_n").alias("windows_per_series"),
        F.sum("_n").alias("window_count"),
    )
