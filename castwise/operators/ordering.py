"""Exact ordering at scale: running totals, ranks, medians and top-n rows per group.

None of these sends a whole group to one task.  Rows are range-partitioned on
(group, order), written once so that partition ids stay fixed, numbered inside
each range piece, and shifted by the piece offsets; only the offsets (one row per
group and piece) meet in a window.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castwise.session import written


def with_running_total(
    df: DataFrame, order_by: Sequence[str], value: Column | None = None, group_by: Sequence[str] = (), out: str = "running"
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (exclusive), in ``order_by`` order.

    ``order_by`` must be a total order inside a group.
    """
    keys = [*group_by, *order_by]
    ranged = df.withColumn("_v", F.lit(1) if value is None else value).repartitionByRange(*[F.col(k) for k in keys])
    pieces = written(ranged.withColumn("_p", F.spark_partition_id()), "ranged")
    inside = W.partitionBy(*group_by, "_p").orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = pieces.withColumn("_in", F.sum("_v").over(inside) - F.col("_v"))
    offsets = pieces.groupBy(*group_by, "_p").agg(F.sum("_v").alias("_sum"))
    before = W.partitionBy(*group_by).orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = offsets.withColumn("_off", F.sum("_sum").over(before) - F.col("_sum"))
    names = [*group_by, "_p"]
    match = None
    o = offsets.select(*[F.col(n).alias(f"_o{n}") for n in names], "_off")
    for n in names:
        same = local[n].eqNullSafe(o[f"_o{n}"])
        match = same if match is None else match & same
    return local.join(o, match).withColumn(out, F.col("_off") + F.col("_in")).select(*df.columns, out)


def with_rank(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based exact rank inside the group."""
    if not group_by:
        return _with_place(df, order_by, out)
    return with_running_total(df, order_by, None, group_by, out).withColumn(out, F.col(out).cast("long"))


PIECE_BITS = 33  # monotonically_increasing_id: number of the task above, place in it below


def _with_place(df: DataFrame, order_by: Sequence[str], out: str) -> DataFrame:
    """Rank over all rows: they are sorted in their range pieces before these are written, so a row's place needs no further shuffle."""
    ranged = df.repartitionByRange(*[F.col(k) for k in order_by]).sortWithinPartitions(*order_by)
    own = f"_row_{uuid.uuid4().hex}"  # a name that no column of the table has
    pieces = written(ranged.withColumn(own, F.monotonically_increasing_id()), "ranged")
    piece = F.shiftright(own, PIECE_BITS)
    sizes = pieces.groupBy(piece.alias(f"{own}_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy(f"{own}_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(f"{own}_p", (F.sum("_c").over(before) - F.col("_c")).alias(f"{own}_off"))  # a row for every task
    place = F.col(own).bitwiseAND(F.lit((1 << PIECE_BITS) - 1))
    joined = pieces.withColumn(f"{own}_p", piece).join(F.broadcast(offsets), f"{own}_p")
    return joined.select(*df.columns, (F.col(f"{own}_off") + place).cast("long").alias(out))


def exact_median(df: DataFrame, value: str, group_by: Sequence[str], out: str = "median") -> DataFrame:
    """Exact median per group.  Equal values are counted first, then ranked by running count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group_by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = with_running_total(counts, [value], F.col("_c"), group_by, "_start")
    totals = counts.groupBy(*group_by).agg(F.sum("_c").alias("_n"))
    r = ranked.join(totals, list(group_by))
    end = F.col("_start") + F.col("_c")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_start") <= position) & (position < end), F.col(value)))

    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    return r.groupBy(*group_by).agg(((at(low) + at(high)) / 2).alias(out))


def first_per_group(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each group in ``order_by`` order, by exact ranks without a whole group in one task."""
    return with_rank(df, order_by, group_by, "_rn").filter(F.col("_rn") < n).drop("_rn")


def with_order(df: DataFrame, col: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Position of ``col`` in a display order (0-based, NULL when absent)."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col))
    return df.withColumn(out or f"{col}_order", F.nullif(pos, F.lit(0)).cast("int") - 1)


def sort_samples(df: DataFrame) -> DataFrame:
    """Canonical sample order."""
    return df.orderBy("config_name", "split", "dataset_name", "item_id", "channel_id", "window_index")


def sort_forecasts(df: DataFrame, experts: Sequence[str]) -> DataFrame:
    """By sample, then expert order."""
    return df.orderBy("sample_key", F.array_position(F.array(*[F.lit(e) for e in experts]), F.col("model_name")))


def preview(df: DataFrame, n: int, order_by: Sequence[str] = ("sample_key",)) -> DataFrame:
    """First ``n`` rows of an ordered table (a top-k per task, then one merge)."""
    return df.orderBy(*order_by).limit(n)
