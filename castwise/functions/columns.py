"""Scalar and array column expressions used by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_key() -> Column:
    """``{config}__{split}__{dataset}__item{i}__ch{c}__win{w}``."""
    return F.concat(
        F.col("config_name"),
        F.lit("__"),
        F.col("split"),
        F.lit("__"),
        F.col("dataset_name"),
        F.lit("__item"),
        F.col("item_id").cast("string"),
        F.lit("__ch"),
        F.col("channel_id").cast("string"),
        F.lit("__win"),
        F.col("window_index").cast("string"),
    )


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    # NaN sorts above every number in Spark, so one range test catches all three.
    return F.when(F.abs(c) < F.lit(float("inf")), c).otherwise(F.lit(0.0))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & (F.abs(c) < F.lit(float("inf")))


def ratio(a: Column, b: Column) -> Column:
    """a/b as double, NULL when b is 0 (ANSI-safe)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# --- arrays -----------------------------------------------------------------


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column used inside an array lambda would otherwise be computed again for
    every element once the optimizer merges the projections.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def asum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def amean(arr: Column) -> Column:
    return ratio(asum(arr), F.size(arr))


def central_sum(arr: Column, mean: Column, power: int) -> Column:
    """``sum((v - mean) ** power)``."""

    def term(v: Column, m: Column) -> Column:
        d = v - m
        out = d
        for _ in range(power - 1):
            out = out * d
        return out

    return let(mean, lambda m: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + term(v, m)))


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda u, v: u * v))


def argmin_name(values: Sequence[Column], names: Sequence[str]) -> Column:
    """Name of the first smallest value; earlier names win ties."""
    arr = F.array(*values)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, F.array_min(arr)).cast("int"))


def argmax_name(values: Sequence[Column], names: Sequence[str]) -> Column:
    """Name of the first largest value; earlier names win ties."""
    arr = F.array(*values)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(arr, F.array_max(arr)).cast("int"))


def pick(name: Column, names: Sequence[str], values: Sequence[Column]) -> Column:
    """Value of the column named by ``name``: a CASE over the fixed expert list."""
    expr = F.when(name == names[0], values[0])
    for n, v in zip(names[1:], values[1:]):
        expr = expr.when(name == n, v)
    return expr


def abs_error_mean(y_true: Column, y_pred: Column) -> Column:
    """Mean absolute error of two arrays; unequal lengths are an error."""
    err = ratio(asum(F.zip_with(y_true, y_pred, lambda t, p: F.abs(p - t))), F.size(y_true))
    return _same_length(y_true, y_pred, err)


def square_error_mean(y_true: Column, y_pred: Column) -> Column:
    err = ratio(asum(F.zip_with(y_true, y_pred, lambda t, p: (p - t) * (p - t))), F.size(y_true))
    return _same_length(y_true, y_pred, err)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("y_true and y_pred differ in length")).cast("double")
    )


# --- weights ----------------------------------------------------------------

WEIGHT_FLOOR = 1e-8


def softmax(logits: Column) -> Column:
    """Row softmax of an array, shifted by its maximum."""
    return normalize(let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top))))


def normalize(arr: Column) -> Column:
    return let(arr, lambda a: let(asum(a), lambda total: F.transform(a, lambda v: v / total)))


def entropy(weights: Column) -> Column:
    """``-sum(w ln max(w, 1e-8))``."""
    return -asum(F.transform(weights, lambda w: w * F.log(F.greatest(w, F.lit(WEIGHT_FLOOR)))))
