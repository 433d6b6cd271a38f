"""Findings of report r03 on larger tables: the same results from less work."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as reg
from castwise.functions import spectral
from castwise.operators import ordering, sampling, transforms, validate, windows
from castwise.plans import derived
from castwise.plans.workspace import Workspace, workspace
from castwise.sources import panel as source

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_blocks_regimes_and_lengths_need_no_long_panel(spark):
    ws = Workspace(spark, SF)
    ws.root += uuid.uuid4().hex
    blocks, series = ws.blocks(), ws.series()
    assert not ws.regimes().isEmpty() and "panel" not in ws._schemas
    panel = ws.panel()
    assert same(blocks, derived.blocks_from(panel))
    assert same(series, derived.scored(panel).groupBy("split", *derived.SERIES).agg(F.count(F.lit(1)).alias("_steps")))


@pytest.mark.parametrize(("block", "width"), [(16, 5), (30, 60), (1024, 10)])
def test_pieces_of_items_in_several_rows(spark, block, width):
    rows = [(i, s, float((i * s) % 7)) for i in range(4) for s in range(0, 130, i + 1)]
    events = spark.createDataFrame(rows, "i long, s int, v double")
    dense, length = source.panel_blocks(events, F.col("i"), F.col("s"), [F.col("v"), F.lit(1.0)], block=50)
    bounds = source.share_bounds(length, derived.SHARES)
    scaled = source.scaled_blocks(dense, "d", bounds)
    pieces = source.pieces_to_series(source.split_pieces(scaled, bounds, width, block=block), max(block, width))
    assert same(pieces, windows.series_blocks(source.panel_of(scaled, bounds), width, block))


def test_moments_of_cut_items_add_up():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(2, 90)) * source.GRID) / source.GRID
    raw = np.floor(np.abs(v) * 3)
    calc = lambda *parts: np.sum([derived.moments_of.func(*[pa.array([c]) for c in p]).to_pylist()[0] for p in parts], axis=0)
    whole = calc((v.tolist(), raw.tolist(), 3, 90, 12))
    cut = [(v[:, a : a + 42].tolist(), raw[:, a : a + 42].tolist(), 3 + a, 30, 12) for a in (0, 30, 60)]
    assert np.array_equal(whole, calc(*cut))
    y = np.floor(v.mean(axis=0) * source.GRID + 0.5) / source.GRID
    assert whole[6] == 89 and whole[9] == 78 and np.isclose(whole[10], (y[:-12] * y[12:]).sum())
    assert np.isclose(whole[5], ((3 + np.arange(90)) * y).sum()) and whole[15] == (raw == 0).sum()


def test_items_are_added_up_where_errors_are_made(spark):
    """one row a window reaches the aggregation, not one for each expert."""
    ws = workspace(spark, SF)
    items = derived.items_of(ws.windows())
    assert "y_pred" not in plan(items) and same(items, derived.items_from(ws.forecasts()))


@pytest.mark.parametrize("name", ["d7_to_pixels", "d9_power_profile", "d11_encoder_scale"])
def test_window_checks_take_no_array_lambdas(spark, name):
    """F29, F36, F42."""
    assert "lambdafunction" not in plan(reg.queries()[name](spark, SF))


def test_arrow_pixels_equal_their_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0, 2.0, 9.0]), (2, [3.0] * 4), (1, []), (1, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 8.0])], "c int, x array<double>")
    old = transforms.normalize_windows(df).withColumn("px", transforms.to_pixels(F.col("x_norm"), 2.0))
    old = old.select("px", transforms.clip_ratio(F.col("x_norm"), 2.0), transforms.encoder_scale(F.col("px"), F.col("c"), "torchvision_imagenet"))
    new = df.select(
        transforms.window_pixels("x", 2.0), transforms.window_clip_ratio("x", 2.0), transforms.window_encoder_pixels("x", "c", 2.0, "torchvision_imagenet")
    )
    for a, b in zip(old.collect()[:2] + old.collect()[3:], new.collect()[:2] + new.collect()[3:]):
        assert np.allclose(a[0], b[0], atol=1e-12) and a[1] == b[1] and np.allclose(a[2], b[2], atol=1e-12)
    assert list(new.collect()[2]) == [[], None, []]


def test_fixed_lags_use_no_factorisation_by_window(monkeypatch):
    """all windows at once, equal to least squares."""
    m = np.random.default_rng(1).normal(size=(50, 24)).cumsum(axis=1)
    want = []
    for x in m:
        d, level = np.diff(x), x[:-1]
        a = np.column_stack([np.ones(22), level[1:], d[:-1]])
        beta, ssr, *_ = np.linalg.lstsq(a, d[1:], rcond=None)
        want.append(beta[1] / np.sqrt(ssr[0] / (22 - 3) * np.linalg.inv(a.T @ a)[1, 1]))

    def refuse(*_, **__):
        raise AssertionError("a factorisation of every window")

    monkeypatch.setattr(np.linalg, "qr", refuse)
    assert np.allclose(spectral.adf_statistic(m, 1), want, rtol=1e-9)


def test_samples_from_lengths(spark):
    """F34, F40."""
    ws = workspace(spark, SF)
    for strategy in ("tsf_balanced", "even_spaced"):
        cfg = sampling.SampleConfig("24_6_S", 24, 6, items=4, windows=3, channels=2, strategy=strategy)
        new = sampling.samples_of_series(ws.series(), ws.regimes(), cfg)
        assert not new.isEmpty() and same(new, sampling.build_samples(derived.scored(ws.panel()), ws.regimes(), cfg))


def test_bad_arrays_in_generated_code(spark):
    """F37."""
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0]
    rows = [("ok", good, good), ("nan", [1.0, nan], good), ("inf", good, [inf, 1.0]), ("neg", good, [1.0, -inf]), ("null", [None, 1.0], good),
            ("nulls", good, [None, None]), ("none", None, good), ("short", good, [1.0]), ("empty", [], good)]
    df = spark.createDataFrame([(k, t, p, 2) for k, t, p in rows], "k string, y_true array<double>, y_pred array<double>, pred_length int")
    bad = validate.bad_arrays(df)
    assert {r.k for r in bad.collect()} == {k for k, *_ in rows} - {"ok"} and "lambdafunction" not in plan(bad)
    none = spark.createDataFrame([("z", [], [], 0)], df.schema)
    assert validate.bad_arrays(none).isEmpty()


def test_rank_over_all_rows_moves_them_once(spark):
    """F39."""
    df = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("k")).repartition(16)
    ranked = ordering.with_rank(df, ["k"])
    assert plan(ranked).count("Exchange hashpartitioning") <= 1  # of the sizes of the pieces
    got = ranked.orderBy("k").collect()
    assert [r["rank"] for r in got] == list(range(5000)) and dict(ranked.dtypes)["rank"] == "bigint"


def test_integrity_is_counted_in_hash_tables(spark):
    """metadata as numbers, so that no forecast is sorted; a changed column is still found."""
    ws = workspace(spark, SF)
    assert "SortAggregate" not in plan(validate.integrity_report(ws.forecasts(), derived.EXPERTS))
    rows = ws.forecasts().filter("window_index < 2")
    odd = (F.col("window_index") == 0) & (F.col("model_name") == "ses")
    other = rows.withColumn("history_length", F.when(odd, None).otherwise(F.col("history_length")))
    n = rows.filter(odd).count()
    report = validate.integrity_report(other.unionByName(rows.filter(odd)), derived.EXPERTS).first()
    assert n and report.unstable_samples == n and report.duplicate_forecasts == n and not report.passed
