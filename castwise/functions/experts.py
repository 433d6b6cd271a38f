"""Simple history-only experts and their errors over Arrow batches of windows.

Windows of equal length are handled as matrices, step by step over all windows at once; sums run over the steps in
order, as in the column form of the metrics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.functions.spectral import by_length

SES_ALPHA = 0.3
GRID = 1048576.0  # values are multiples of its inverse, see sources.panel.on_grid

_LIST = T.ArrayType(T.DoubleType())
EXPERT_COLUMNS = T.StructType([T.StructField(n, _LIST) for n in ("y_pred", "mae", "mse")])


def _grid(v: np.ndarray) -> np.ndarray:
    return np.floor(v * GRID + 0.5) / GRID


def predict(x: np.ndarray, horizon: int, season: int) -> np.ndarray:
    """Last value, seasonal repeat, mean, drift and exponential smoothing: (windows, experts, horizon)."""
    steps = np.ascontiguousarray(x.T)
    n = len(steps)
    first, last = steps[0], steps[-1]
    total, level = np.zeros_like(first), first
    for k, v in enumerate(steps):
        total = total + v
        if k:
            level = SES_ALPHA * v + (1 - SES_ALPHA) * level
    ahead = np.arange(horizon)
    out = np.empty((len(x), 5, horizon))
    out[:, 0] = last[:, None]
    out[:, 1] = x[:, n - season + ahead % season]
    out[:, 2] = _grid(total / n)[:, None]
    slope = (last - first) / (n - 1) if n > 1 else np.full_like(first, np.nan)
    out[:, 3] = _grid(last[:, None] + (ahead + 1) * slope[:, None])
    out[:, 4] = _grid(level)[:, None]
    return out


def errors(preds: np.ndarray, true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean absolute and mean square error: (windows, experts) each."""
    mae = np.zeros(preds.shape[:2])
    mse = np.zeros(preds.shape[:2])
    for k in range(true.shape[1]):
        d = preds[:, :, k] - true[:, k, None]
        mae += np.abs(d)
        mse += d * d
    return mae / true.shape[1], mse / true.shape[1]


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))


@F.arrow_udf(EXPERT_COLUMNS)
def simple_experts_of(x: pa.Array, y_true: pa.Array, season: pa.Array) -> pa.Array:
    """Per window: the experts' predictions one after the other, and their errors."""
    names, seasons = EXPERT_COLUMNS.names, np.asarray(season)
    horizons = np.asarray(y_true.value_lengths())
    places, parts = [], []
    for rows, m in by_length(x):
        for at, true in by_length(y_true.take(pa.array(rows)) if len(rows) < len(x) else y_true):
            for s in np.unique(seasons[rows[at]]):
                mine = np.flatnonzero(seasons[rows[at]] == s)
                preds = predict(m[at[mine]], true.shape[1], int(s))
                mae, mse = errors(preds, true[mine])
                places.append(rows[at[mine]])
                parts.append([_lists(v) for v in (preds.reshape(len(preds), -1), mae, mse)])
    if sum(map(len, places)) != len(x) or (horizons == 0).any():
        raise ValueError("a window without a history or a future")
    if not parts:
        return pa.StructArray.from_arrays([pa.array([], pa.list_(pa.float64()))] * 3, names=names)
    back = pa.array(np.argsort(np.concatenate(places), kind="stable"))
    columns = [pa.concat_arrays([p[i] for p in parts]) for i in range(3)]
    return pa.StructArray.from_arrays([c if len(parts) == 1 else c.take(back) for c in columns], names=names)


@F.arrow_udf(_LIST)
def simple_errors_of(x: pa.Array, y_true: pa.Array, season: pa.Array) -> pa.Array:
    """Per window: the experts' mean absolute errors, then their mean square errors; the predictions are not returned."""
    seasons = np.asarray(season)
    out, done = None, 0
    for rows, m in by_length(x):
        for at, true in by_length(y_true.take(pa.array(rows)) if len(rows) < len(x) else y_true):
            for s in np.unique(seasons[rows[at]]):
                mine = np.flatnonzero(seasons[rows[at]] == s)
                found = np.hstack(errors(predict(m[at[mine]], true.shape[1], int(s)), true[mine]))
                out = np.empty((len(x), found.shape[1])) if out is None else out
                out[rows[at[mine]]] = found
                done += len(mine)
    if done != len(x):
        raise ValueError("a window without a history or a future")
    return _lists(np.empty((0, 1)) if out is None else out)
