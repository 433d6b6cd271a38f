import numpy as np
import pytest
from pyspark.sql import functions as F

from castwise.functions import spectral
from castwise.operators import features, transforms
from castwise.schemas import FEATURES


def frame(spark, windows):
    return spark.createDataFrame([(str(i), [float(v) for v in w]) for i, w in enumerate(windows)], "sample_key string, x array<double>")


def by_hand(x):
    x = np.asarray(x, float)
    d = x - x.mean()
    m2 = (d**2).mean()
    out = {"mean": x.mean(), "std": np.sqrt(m2), "min": x.min(), "max": x.max()}
    out["skewness"] = (d**3).mean() / m2**1.5 if m2 > 0 else 0.0
    out["kurtosis"] = (d**4).mean() / m2**2 - 3 if m2 > 0 else 0.0
    out["autocorrelation_mean"] = (d[:-1] * d[1:]).sum() / (d**2).sum() if m2 > 0 else 0.0
    keep = x[:-1] != 0
    r = (x[1:][keep] - x[:-1][keep]) / x[:-1][keep]
    out["rate_of_change_mean"] = r.mean() if r.size else 0.0
    out["rate_of_change_std"] = r.std() if r.size else 0.0
    a = np.column_stack([np.ones(len(x) - 1), x[:-1]])
    beta = np.linalg.pinv(a) @ x[1:]
    out["autoreg_coef_mean"] = beta[1]
    out["residual_std_mean"] = (x[1:] - a @ beta).std()
    n = len(x)
    psd = np.abs(np.fft.rfft(d)) ** 2 / n
    psd[1 : (n + 1) // 2] *= 2
    out["frequency_mean"] = psd.mean()
    p = (psd + 1e-12) / (psd + 1e-12).sum()
    out["spectral_entropy"] = -(p * np.log(p)).sum()
    return out


WINDOWS = [
    np.sin(np.arange(24) * 0.7) + 0.1 * np.arange(24),
    np.random.default_rng(5).normal(size=24),
    np.full(24, 0.75),
    np.zeros(24),
    np.r_[np.zeros(10), 3.0, np.zeros(13)],
    np.random.default_rng(6).normal(size=31),
]


def test_features_match_direct_formulas_in_both_forms(spark):
    df = frame(spark, WINDOWS)
    arrow = df.select("sample_key", spectral.arrow_features_of("x").alias("f")).select("sample_key", "f.*").toPandas().set_index("sample_key")
    jvm = features.ar1_features(features.rate_of_change(features._with_moments(df))).toPandas().set_index("sample_key")
    for i, w in enumerate(WINDOWS):
        for name, value in by_hand(w).items():
            both = jvm if name in jvm.columns else arrow
            assert both.loc[str(i), name] == pytest.approx(value, abs=1e-9), (i, name)
    assert set(FEATURES) <= set(arrow.columns) | set(jvm.columns)


def test_features_that_are_not_read_are_not_computed(spark):
    names = "sample_key config_name split dataset_name item_id channel_id window_index history_length pred_length".split()
    df = frame(spark, WINDOWS).select("x", *[F.lit("1").alias(n) for n in names])
    plan = lambda *cols: features.build_features(df).select(*cols)._jdf.queryExecution().executedPlan().toString()
    assert "stationarity_of" in plan(*FEATURES)
    assert "time_features_of" in plan("mean") and "spectral_features_of" not in plan("mean") and "stationarity_of" not in plan("mean", "frequency_peak")
    assert "ArrowEval" not in plan("feature_version")


def test_power_columns_of_odd_and_short_windows(spark):
    rng = np.random.default_rng(9)
    df = frame(spark, [rng.normal(size=n) for n in (1, 2, 3, 4, 5, 24, 31)])
    for r in transforms.with_power_columns(df, out="p").collect():
        assert r.p == pytest.approx(list(spectral.power_of(np.array([r.x]))[0]), abs=1e-9)
    waves = transforms.twiddle_table(spark.createDataFrame([(24,)], "_len int")).first()._turns
    assert {(len(w.c), len(w.s)) for w in waves} == {(13, 11)}  # half of the window


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    x = pa.array([list(w) for w in WINDOWS * 3])
    run = lambda: spectral._features(x, ["a", "b"], lambda m: np.column_stack([m.sum(axis=1), spectral.is_stationary(m)]), lambda n: n)
    whole = run()
    monkeypatch.setattr(spectral, "PIECE_BYTES", 1)
    assert run().equals(whole)


def test_power_in_columns_and_exact_ranks(spark):
    df = frame(spark, [*WINDOWS, [3.0], [1.0, 2.0]])
    both = transforms.with_power_columns(transforms.with_power(df), out="columns").collect()
    for r in both:
        assert len(r.power) == len(r["columns"]) == len(r.x) // 2
        assert np.allclose(r.power, r["columns"], atol=1e-10 * (1 + sum(r.power)))
    # two bins that differ by a millionth of the total are told apart, equal ones go to the lower bin
    t = np.arange(24)
    waves = [np.cos(2 * np.pi * 3 * t / 24) + (1 + 1e-6) * np.cos(2 * np.pi * 5 * t / 24), np.cos(2 * np.pi * 3 * t / 24) + np.cos(2 * np.pi * 5 * t / 24)]
    got = [r.periods for r in transforms.top_periods_dynamic(frame(spark, waves), 2).orderBy("sample_key").collect()]
    assert got == [[5, 8], [8, 5]]


def test_unit_root_statistics_at_fixed_lags(spark):
    w = np.cumsum(np.random.default_rng(8).normal(size=40))
    d, level = np.diff(w), w[:-1]
    got = features.adf_statistics(frame(spark, [w, np.ones(9)]), [0, 1]).orderBy("sample_key").collect()
    for lag in (0, 1):
        x = np.column_stack([np.ones(39 - lag), level[lag:], *[d[lag - i : 39 - i] for i in range(1, lag + 1)]])
        y = d[lag:]
        beta, (ssr,), *_ = np.linalg.lstsq(x, y)
        se = np.sqrt(ssr / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert got[0].adf[lag] == pytest.approx(beta[1] / se)
    assert got[1].adf == [0.0, 0.0]


def test_variants_are_drawn_in_one_pass(spark):
    df = frame(spark, WINDOWS)
    pick = lambda images: sorted((r.sample_key, r.variant, tuple(r.pixels)) for r in images.collect())
    alone = [pick(transforms.imageize(df, v, size=8)) for v in ("3view", "top3fold")]
    assert pick(transforms.imageize(df, ["3view", "top3fold"], size=8)) == sorted(alone[0] + alone[1])


def adf_by_loop(x):
    """Plain textbook form of the test, one regression per lag."""
    n = len(x)
    top = min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25)))
    d = np.diff(x)

    def fit(lag, skip):
        rows = range(skip, len(d))
        a = np.array([[1.0, x[t], *[d[t - i] for i in range(1, lag + 1)]] for t in rows])
        y = np.array([d[t] for t in rows])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        r = y - a @ beta
        return a, beta, r @ r, len(y)

    aic = []
    for lag in range(top + 1):
        a, _, ssr, m = fit(lag, top)
        aic.append(m * (np.log(2 * np.pi) + np.log(ssr / m) + 1) + 2 * a.shape[1])
    lag = int(np.argmin(aic))
    a, beta, ssr, m = fit(lag, lag)
    cov = np.linalg.inv(a.T @ a) * ssr / (m - a.shape[1])
    return beta[1] / np.sqrt(cov[1, 1])


def test_unit_root_statistic_matches_plain_regressions():
    rng = np.random.default_rng(11)
    m = np.vstack([rng.normal(size=(10, 48)), rng.normal(size=(10, 48)).cumsum(axis=1)])
    got = spectral.adf_statistic(m)
    assert np.allclose(got, [adf_by_loop(r) for r in m], atol=1e-8)
    assert spectral.is_stationary(m[:10]).mean() > spectral.is_stationary(m[10:]).mean()
    assert spectral.is_stationary(np.full((1, 48), 2.0))[0] == 0.0


def test_period_candidates(spark):
    def cand(n, extra=None):
        return spark.range(1).select(transforms.period_candidates(F.lit(n), extra).alias("c")).first().c

    assert cand(13) == [2, 3, 4, 5, 6, 8, 10, 12, 13]
    assert cand(7, [1, 3, 99, 3]) == [2, 3, 7]


def test_top_periods_of_a_sine_and_half_even_rounding(spark):
    sine = np.sin(2 * np.pi * np.arange(48) / 12)
    got = transforms.top_periods(frame(spark, [sine]), 3).first().periods
    assert got[0] == 12
    dyn = transforms.top_periods_dynamic(frame(spark, [sine, np.zeros(5)]), 3).orderBy("sample_key").collect()
    assert dyn[0].periods[0] == 12
    # bins of length 5: 5/1 = 5, 5/2 = 2.5 -> 2 (half to even), then fill 4
    assert dyn[1].periods == [5, 2, 4]


def test_period_fold_pads_with_last_value(spark):
    df = frame(spark, [np.arange(7)]).withColumn("p", F.lit(3))
    assert transforms.period_fold(df, "p").first().fold == [[0, 1, 2], [3, 4, 5], [6, 6, 6]]


def resize(img, size):
    """Bilinear resize with aligned corners, one pixel at a time."""
    h, w = img.shape
    out = np.empty((size, size))
    for r in range(size):
        for c in range(size):
            y, x = r * (h - 1) / (size - 1), c * (w - 1) / (size - 1)
            y0, x0 = int(min(np.floor(y), max(h - 2, 0))), int(min(np.floor(x), max(w - 2, 0)))
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            fy, fx = y - y0, x - x0
            out[r, c] = (
                img[y0, x0] * (1 - fy) * (1 - fx) + img[y0, x1] * (1 - fy) * fx + img[y1, x0] * fy * (1 - fx) + img[y1, x1] * fy * fx
            )
    return out


def test_images_match_pixel_by_pixel_drawing(spark):
    rng = np.random.default_rng(2)
    ws = [rng.normal(size=24) for _ in range(4)] + [rng.normal(size=13)]
    df = frame(spark, ws)
    size = 8
    fold = {r.sample_key: np.array(r.pixels).reshape(3, size, size) for r in transforms.imageize(df, "top3fold", size, "none").collect()}
    three = {r.sample_key: np.array(r.pixels).reshape(3, size, size) for r in transforms.imageize(df, "3view", size, "none").collect()}
    periods = {r.sample_key: r.periods for r in transforms.top_periods(df, 3).collect()}
    for i, w in enumerate(ws):
        key = str(i)
        for c in range(3):
            p = periods[key][c]
            cycles = -(-len(w) // p)
            grid = np.r_[w, np.repeat(w[-1], cycles * p - len(w))].reshape(cycles, p)
            want = (np.clip(resize(grid, size), -5, 5) + 5) / 10
            assert np.allclose(fold[key][c], want, atol=1e-6)
        assert np.allclose(three[key][1], fold[key][0])
        logs = np.log1p(np.abs(np.fft.rfft(w - w.mean())[1:]) ** 2)
        prof = (logs - logs.min()) / (logs.max() - logs.min())
        want = np.interp(np.linspace(0, len(prof) - 1, size), np.arange(len(prof)), prof)
        assert np.allclose(three[key][2], np.repeat(want[:, None], size, axis=1), atol=1e-6)
        y = np.interp(np.linspace(0, len(w) - 1, size), np.arange(len(w)), (1 - (np.clip(w, -5, 5) + 5) / 10) * (size - 1))
        assert np.allclose(three[key][0], np.exp(-0.5 * (np.arange(size)[:, None] - y[None, :]) ** 2), atol=1e-6)


def test_clip_and_encoder_scale(spark):
    df = spark.createDataFrame([([-9.0, 0.0, 9.0, 1.0],)], "x array<double>")
    r = df.select(
        transforms.to_pixels(F.col("x")).alias("p"),
        transforms.clip_ratio(F.col("x")).alias("c"),
        transforms.encoder_scale(transforms.to_pixels(F.col("x")), F.lit(0)).alias("e"),
    ).first()
    assert r.p == [0.0, 0.5, 1.0, 0.6] and r.c == 0.5 and r.e == pytest.approx([-1.0, 0.0, 1.0, 0.2])
