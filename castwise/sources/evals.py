"""Evaluation JSON and packed arrays as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwise.operators.audit import ITEM_METRICS
from castwise.schemas import EVAL_JSON_SCHEMA


def explode_eval_results(df: DataFrame, json_col: str, metrics: Sequence[str] = ITEM_METRICS) -> DataFrame:
    """One row per item of an evaluation document: counts, time and one column per metric."""
    others = [c for c in df.columns if c != json_col]
    doc = df.select(*others, F.from_json(json_col, EVAL_JSON_SCHEMA).alias("_d"))
    rows = doc.select(*others, F.explode("_d.final_results").alias("_r"))
    return rows.select(
        *others,
        F.col("_r.user_id").alias("item_id"),
        F.col("_r.n_samples").alias("n_samples"),
        F.col("_r.eval_time").alias("eval_time"),
        *[F.try_element_at("_r.metrics", F.lit(m)).alias(m) for m in metrics],
    )


def unpack_arrays(df: DataFrame, packed: str, out: str = "y") -> DataFrame:
    """Rows of a packed array-of-arrays with their row index."""
    others = [c for c in df.columns if c != packed]
    return df.select(*others, F.posexplode(packed).alias("row_index", out))


def read_regimes(df: DataFrame, on_duplicate: str = "first") -> DataFrame:
    """Regime dimension with one row per item.

    ``first`` keeps the smallest row of an item (so the result does not depend on
    file order); ``error`` fails the job on a repeated item.
    """
    from castwise.schemas import REGIME

    missing = [c for c in ["item_id", *REGIME] if c not in df.columns]
    if missing:
        raise ValueError(f"regime table lacks {missing}")
    g = df.groupBy("item_id").agg(F.min(F.struct(*REGIME)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    item = F.col("item_id")
    if on_duplicate == "error":
        item = F.when(F.col("_n") == 1, item).otherwise(
            F.raise_error(F.concat(F.lit("repeated item "), item.cast("string"))).cast("long")
        )
    return g.select(item.alias("item_id"), "_r.*")
