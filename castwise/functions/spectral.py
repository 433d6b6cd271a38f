"""Arrow functions over arrays of windows: spectra and the unit-root test.

Each call gets one Arrow batch of windows.  Windows of equal length are stacked to
a matrix and handled together; nothing is looped per row in Python except the rare
rank-deficient regressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


# MacKinnon (1994) response surface of the Dickey-Fuller tau statistic,
# constant only, one variable: p = Phi(b0 + b1 tau + b2 tau^2) for tau <= -1.61,
# p = 0 below -18.83.
TAU_SURFACE = (2.1659, 1.4412, 0.038269)
TAU_LEFT_MAX = -1.61
TAU_MIN = -18.83
NORMAL_5_PERCENT = -1.6448536269514722

PSD_FLOOR = 1e-12

# Bins whose powers differ by less than this share of the total power count as equal: it lies far
# above the rounding error of any way to sum them, and far below any difference of the data.
POWER_TIE = 1e-12
PIECE_BYTES = 1 << 26  # of the arrays that one piece of a batch makes
SPECTRAL = ["frequency_mean", "frequency_peak", "spectral_entropy", "spectral_skewness", "spectral_kurtosis"]


def _doubles(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def by_length(x: pa.Array):
    """(row numbers, matrix) for every window length in the batch."""
    lengths = np.asarray(x.value_lengths().fill_null(0))
    flat = np.asarray(x.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths):
        if n == 0:
            continue
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def lists_of(x: pa.Array, compute) -> pa.Array:
    """``compute(rows, matrix)`` of the windows of each length, a row of numbers for every window, as lists in the order of ``x``."""
    places, parts = [], []
    for rows, m in by_length(x):
        found = np.ascontiguousarray(compute(rows, m))
        places.append(rows)
        parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel())))
    if len(parts) == 1 and len(places[0]) == len(x):
        return parts[0]
    empty = np.setdiff1d(np.arange(len(x)), np.concatenate([np.empty(0, dtype=int), *places]))
    parts.append(pa.ListArray.from_arrays(pa.array(np.zeros(len(empty) + 1, dtype=np.int32)), pa.array(np.empty(0))))
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([*places, empty]), kind="stable")))


def _power(m: np.ndarray) -> np.ndarray:
    spectrum = np.fft.rfft(m - m.mean(axis=1, keepdims=True), axis=1)
    return np.square(spectrum.real) + np.square(spectrum.imag)


def power_of(m: np.ndarray) -> np.ndarray:
    """Spectral power of the centered windows without their DC bin."""
    return _power(m)[:, 1:]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def power(x: pa.Array) -> pa.Array:
    """Spectral power of the centered window without its DC bin."""
    return lists_of(x, lambda _, m: power_of(m))


@F.arrow_udf(T.DoubleType())
def checksum_of(x: pa.Array) -> pa.Array:
    """Sum of value times position (from 1), taken in order; 0 for an empty list."""
    out = np.zeros(len(x))
    for rows, m in by_length(x):
        out[rows] = _folded((m * np.arange(1, m.shape[1] + 1)).T)
    return pa.array(out)


def _moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Biased skewness and excess kurtosis per row; 0 for constant rows."""
    mean = v.mean(axis=1, keepdims=True)
    d = v - mean
    m2 = np.mean(d**2, axis=1)
    flat = m2 <= (np.finfo(float).eps * mean[:, 0]) ** 2
    safe = np.where(flat, 1.0, m2)
    skew = np.where(flat, 0.0, np.mean(d**3, axis=1) / safe**1.5)
    kurt = np.where(flat, 0.0, np.mean(d**4, axis=1) / safe**2 - 3.0)
    return skew, kurt


def spectral_matrix(m: np.ndarray) -> np.ndarray:
    """The five periodogram features of every row."""
    n = m.shape[1]
    psd = _power(m) / n
    psd[:, 1 : (n + 1) // 2] *= 2.0
    freqs = np.arange(psd.shape[1]) / n
    # of equal bins the first one is the peak
    near = psd >= psd.max(axis=1, keepdims=True) - POWER_TIE * psd.sum(axis=1, keepdims=True)
    p = psd + PSD_FLOOR
    p = p / p.sum(axis=1, keepdims=True)
    skew, kurt = _moments(psd)
    return np.column_stack(
        [psd.mean(axis=1), freqs[np.argmax(near, axis=1)], -(p * np.log(p)).sum(axis=1), skew, kurt]
    )


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Batched least squares (minimum norm): parameters, their variance factors, ssr, rank."""
    pinv = np.linalg.pinv(x, rcond=1e-12)
    beta = np.einsum("bkn,bn->bk", pinv, y)
    resid = y - np.einsum("bnk,bk->bn", x, beta)
    rank = np.rint(np.einsum("bkn,bnk->b", pinv, x))
    return beta, np.einsum("bkn,bkn->bk", pinv, pinv), np.einsum("bn,bn->b", resid, resid), rank


def _nested_ssr(x: np.ndarray, y: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """ssr and rank of the regressions on the first ``first .. k`` columns, from one QR."""
    q, r = np.linalg.qr(x)
    explained = np.cumsum(np.einsum("bnk,bn->bk", q, y) ** 2, axis=1)
    ssr = np.maximum((y**2).sum(axis=1)[:, None] - explained, 0.0)[:, first - 1 :]
    k = x.shape[2]
    rank = np.broadcast_to(np.arange(first, k + 1, dtype=float), ssr.shape).copy()
    diag = np.abs(np.einsum("bkk->bk", r))
    deficient = np.flatnonzero(diag.min(axis=1) <= 1e-10 * diag.max(axis=1))
    if deficient.size:
        ssr = ssr.copy()
        for j in range(first, k + 1):
            _, _, s, rk = _ols(x[deficient, :, :j], y[deficient])
            ssr[deficient, j - first] = s
            rank[deficient, j - first] = rk
    return ssr, rank


def _lagged(d: np.ndarray, level: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (1, level, lagged differences) and the differences they explain."""
    obs = d.shape[1] - lags
    cols = [np.ones((d.shape[0], obs)), level[:, lags : lags + obs]]
    cols += [d[:, lags - i : lags - i + obs] for i in range(1, lags + 1)]
    return np.stack(cols, axis=2), d[:, lags:]


def most_lags(n: int) -> int:
    """Largest lag tried for a window of ``n`` values."""
    return min(n // 2 - 2, int(np.ceil(12.0 * (n / 100.0) ** 0.25)))


TRIANGLE_ROWS = 1024  # windows handled at once, so that their columns stay near the processor


def _ssr_by_lag(d: np.ndarray, level: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """ssr of the regressions with 0 to ``lags`` lagged differences, and where they are sure: full rank, and no nearly exact fit.

    The centered columns are made orthogonal one after the other, over all windows at once; what is left of ``y`` after each is the ssr.
    """
    obs = d.shape[1] - lags
    dt, lt = np.ascontiguousarray(d.T), np.ascontiguousarray(level.T)
    cols = np.stack([lt[lags : lags + obs], *[dt[lags - i : lags - i + obs] for i in range(1, lags + 1)], dt[lags:]])
    whole = np.einsum("nb,nb->b", cols[-1], cols[-1])
    cols -= cols.mean(axis=1, keepdims=True)
    own = np.einsum("knb,knb->kb", cols, cols)
    sure, ssr = np.ones(len(d), dtype=bool), np.empty((lags + 1, len(d)))
    for j in range(lags + 1):
        size = np.einsum("nb,nb->b", cols[j], cols[j])
        sure &= size > 1e-9 * own[j]
        share = np.einsum("nb,inb->ib", cols[j], cols[j + 1 :]) / np.where(size > 0, size, 1.0)
        cols[j + 1 :] -= share[:, None, :] * cols[j]
        ssr[j] = np.einsum("nb,nb->b", cols[-1], cols[-1])
    return ssr.T, sure & (ssr[-1] > 1e-9 * whole)


def _best_lags(d: np.ndarray, level: np.ndarray, most: int) -> np.ndarray:
    """Number of lagged differences by AIC; the first of equal ones."""
    obs = d.shape[1] - most
    parts = [_ssr_by_lag(d[at : at + TRIANGLE_ROWS // 2], level[at : at + TRIANGLE_ROWS // 2], most) for at in range(0, len(d), TRIANGLE_ROWS // 2)]
    ssr, sure = (np.concatenate(p) for p in zip(*parts))
    rank = np.broadcast_to(np.arange(2, most + 3, dtype=float), ssr.shape).copy()
    rows = np.flatnonzero(~sure)
    if rows.size:
        ssr[rows], rank[rows] = _nested_ssr(*_lagged(d[rows], level[rows], most), 2)
    aic = obs * (np.log(2 * np.pi) + np.log(ssr / obs) + 1.0) + 2.0 * rank
    return np.argmin(np.where(np.isnan(aic), np.inf, aic), axis=1)


def _triangle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangular factor of the regressors (the level last) and ``y``, by modified Gram-Schmidt over all windows at once."""
    k = x.shape[2]
    cols = np.empty((k + 1, x.shape[1], len(x)))
    for i, j in enumerate([0, *range(2, k), 1]):
        cols[i] = x[:, :, j].T
    cols[k] = y.T
    r = np.zeros((len(x), k + 1, k + 1))
    for j in range(k + 1):
        size = np.sqrt(np.einsum("nb,nb->b", cols[j], cols[j]))
        r[:, j, j] = size
        q = cols[j] / np.where(size > 0, size, 1.0)
        for i in range(j + 1, k + 1):
            share = np.einsum("nb,nb->b", q, cols[i])
            r[:, j, i] = share
            cols[i] -= share * q
    return r


def _level_t(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """t statistic of the level. It stands last in one triangular factor, whose last two rows then hold all that is needed."""
    k = x.shape[2]
    r = np.concatenate([_triangle(x[at : at + TRIANGLE_ROWS], y[at : at + TRIANGLE_ROWS]) for at in range(0, len(x), TRIANGLE_ROWS)])
    diag = np.abs(np.einsum("bkk->bk", r[:, :k, :k]))
    scale = r[:, k, k] ** 2 / (y.shape[1] - k)
    t = r[:, k - 1, k] * np.sign(r[:, k - 1, k - 1]) / np.sqrt(scale)
    # nearly dependent regressors, or a nearly exact fit: by the minimum norm
    poor = (diag.min(axis=1) <= 1e-10 * diag.max(axis=1)) | (np.abs(r[:, k, k]) <= 1e-10 * np.sqrt((y**2).sum(axis=1)))
    rows = np.flatnonzero(poor)
    if rows.size:
        beta, var, s2, rk = _ols(x[rows], y[rows])
        t[rows] = beta[:, 1] / np.sqrt(s2 / (y.shape[1] - rk) * var[:, 1])
    return t


def adf_statistic(m: np.ndarray, lag: int | None = None) -> np.ndarray:
    """Augmented Dickey-Fuller t statistic per row (constant; lag by AIC unless given); NaN if undefined."""
    b, n = m.shape
    out = np.full(b, np.nan)
    max_lag = most_lags(n)
    varied = np.flatnonzero(m.max(axis=1) != m.min(axis=1))
    if max_lag < 0 or varied.size == 0:
        return out
    s = m[varied]
    d, level = np.diff(s, axis=1), s[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        best = np.full(len(s), max_lag if lag is None else min(lag, max_lag))
        if lag is None:
            best = _best_lags(d, level, max_lag)
        for chosen in np.unique(best):
            rows = np.flatnonzero(best == chosen)
            x, y = _lagged(d[rows], level[rows], int(chosen))
            out[varied[rows]] = _level_t(x, y)
    return out


def is_stationary(m: np.ndarray) -> np.ndarray:
    """1.0 where the p-value is below 0.05, else 0.0 (also for constant rows)."""
    tau = adf_statistic(m)
    b0, b1, b2 = TAU_SURFACE
    with np.errstate(invalid="ignore"):
        z = b0 + b1 * tau + b2 * tau**2
        small = (tau <= TAU_LEFT_MAX) & ((tau < TAU_MIN) | (z < NORMAL_5_PERCENT))
    return small.astype(float)


def _features(x: pa.Array, names: list[str], compute, width) -> pa.StructArray:
    """``compute`` over pieces of equal windows; ``width(n)`` is how many numbers it makes of a window of ``n``."""
    out = np.zeros((len(x), len(names)))
    for rows, m in by_length(x):
        most = max(1, PIECE_BYTES // (8 * width(m.shape[1])))
        for at in range(0, len(rows), most):
            out[rows[at : at + most]] = compute(m[at : at + most])
    out[~np.isfinite(out)] = 0.0
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(len(names))], names=names)


def _test_width(n: int) -> int:
    return 6 * n * (most_lags(n) + 3)  # regressors, their factors and copies


@F.arrow_udf(_doubles(SPECTRAL))
def spectral_features_of(x: pa.Array) -> pa.Array:
    return _features(x, SPECTRAL, spectral_matrix, lambda n: 8 * n)


ARROW_FEATURES = [*SPECTRAL, "stationarity"]


@F.arrow_udf(_doubles(ARROW_FEATURES))
def arrow_features_of(x: pa.Array) -> pa.Array:
    """Spectrum and unit-root test in one pass over Arrow batches."""
    both = lambda m: np.column_stack([spectral_matrix(m), is_stationary(m)])
    return _features(x, ARROW_FEATURES, both, lambda n: 8 * n + _test_width(n))


TIME_FEATURES = [
    "mean", "std", "min", "max", "skewness", "kurtosis", "autocorrelation_mean",
    "rate_of_change_mean", "rate_of_change_std", "autoreg_coef_mean", "residual_std_mean",
]


def _folded(rows) -> np.ndarray:
    """Sum of the rows in their order."""
    total = 0.0
    for v in rows:
        total = total + v
    return total


def time_matrix(m: np.ndarray) -> np.ndarray:
    """The eleven features of the time domain of every row; what is undefined is not finite.

    Sums run over the steps in order, so that equal steps have exactly their value as mean.
    """
    x = np.ascontiguousarray(m.T)
    n = len(x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        mu = _folded(x) / n
        c = x - mu
        m2, m3, m4 = (_folded(np.prod([c] * p, axis=0)) / n for p in (2, 3, 4))
        eps = np.abs(mu) * np.finfo(float).eps
        flat = m2 <= eps * eps
        skew = np.where(flat, 0.0, m3 / (m2 * np.sqrt(m2)))
        kurt = np.where(flat, 0.0, m4 / (m2 * m2) - 3.0)
        if n > 1:
            lag, cur = x[:-1], x[1:]
            acf = _folded(c[:-1] * c[1:]) / (m2 * n)
            r = (cur - lag) / lag
            known = np.isfinite(r)
            r, count = np.where(known, r, 0.0), known.sum(axis=0)
            rate = _folded(r) / count
            spread = np.sqrt(_folded(np.where(known, (r - rate) ** 2, 0.0)) / count)
            mx, my = _folded(lag) / (n - 1), _folded(cur) / (n - 1)
            u, v = lag - mx, cur - my
            sxx, syy, sxy = _folded(u * u), _folded(v * v), _folded(u * v)
            # equal lagged values: the fit of minimum norm
            level = sxx <= 1e-18
            slope = np.where(level, mx * my / (1 + mx * mx), sxy / sxx)
            left = np.where(level, syy, syy - sxy * sxy / sxx)
            resid = np.sqrt(np.maximum(left / (n - 1), 0.0))
        else:
            acf = rate = spread = slope = resid = np.zeros(len(m))
    return np.column_stack([mu, np.sqrt(m2), x.min(axis=0), x.max(axis=0), skew, kurt, acf, rate, spread, slope, resid])


@F.arrow_udf(_doubles(TIME_FEATURES))
def time_features_of(x: pa.Array) -> pa.Array:
    return _features(x, TIME_FEATURES, time_matrix, lambda n: 8 * n)


@F.arrow_udf(T.DoubleType())
def stationarity_of(x: pa.Array) -> pa.Array:
    return _features(x, ["s"], lambda m: is_stationary(m)[:, None], _test_width).field(0)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def adf_at_lags(x: pa.Array, lags: pa.Array) -> pa.Array:
    """Statistics at the given lags (the same list in every row); 0 where undefined."""
    wanted = lags[0].as_py() if len(lags) else []
    each = lambda m: np.column_stack([adf_statistic(m, k) for k in wanted])
    most = lambda n: max(1, PIECE_BYTES // (8 * max(1, len(wanted)) * _test_width(n)))
    pieces = lambda m: [m[at : at + most(m.shape[1])] for at in range(0, len(m), most(m.shape[1]))]
    found = lists_of(x, lambda _, m: np.nan_to_num(np.concatenate([each(p) for p in pieces(m)]), nan=0.0, posinf=0.0, neginf=0.0))
    if not (pc.list_value_length(found).to_numpy(zero_copy_only=False) == 0).any():
        return found
    return pa.array([v or [0.0] * len(wanted) for v in found.to_pylist()], pa.list_(pa.float64()))  # windows without values
