"""Expert-by-shard grid of a sharded forecast folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_PATTERN = r"shard[=_-]?(\d+)"


def shard_of_path(path: Column) -> Column:
    """Shard number in a file path, NULL when there is none."""
    return F.nullif(F.regexp_extract(path, SHARD_PATTERN, 1), F.lit("")).cast("int")


def shard_grid(rows: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Per shard: experts present, experts missing, rows.  ``rows`` has ``shard`` and ``model_name``."""
    wanted = F.array(*[F.lit(e) for e in experts])
    # collect_set is bounded by the number of experts.
    g = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("row_count"), F.collect_set("model_name").alias("_have"))
    missing = F.array_except(wanted, F.col("_have"))
    return g.select(
        "shard",
        "row_count",
        F.array_join(F.array_intersect(wanted, F.col("_have")), ",").alias("experts"),
        F.array_join(missing, ",").alias("missing_experts"),
        (F.size(missing) == 0).alias("complete"),
    )


def require_full_grid(grid: DataFrame) -> None:
    """Stop when a shard lacks an expert (reads at most one row)."""
    bad = grid.filter(~F.col("complete")).limit(1).collect()
    if bad:
        raise ValueError(f"shard {bad[0]['shard']} lacks experts: {bad[0]['missing_experts']}")
