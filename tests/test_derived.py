"""The derived tables: cheap to read in part, and equal to their plain forms."""

import re

import pytest
from pyspark.sql import functions as F

from castwise.operators import features, oracle, transforms, windows
from castwise.plans import derived, workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ws(spark):
    return workspace.workspace(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_of_forecasts_need_no_experts(ws):
    """A count per expert and window opens blocks; it predicts nothing and writes no forecasts."""
    text = plan(ws.faulty().select("model_name", "window_index"))
    assert "ArrowEvalPython" not in text and "slice(" not in text


def test_labels_stay_in_their_row(ws):
    text = plan(ws.labels())
    assert len(re.findall("Exchange", text)) == len(derived.CONFIGS)  # blocks are dealt to tasks, nothing else moves
    one = oracle.oracle_labels(ws.forecasts(), derived.EXPERTS)
    assert ws.labels().select(one.columns).exceptAll(one).isEmpty() and one.exceptAll(ws.labels().select(one.columns)).isEmpty()


def test_wide_labels_refuse_gaps(spark):
    df = spark.createDataFrame([("k", [1.0, None])], "sample_key string, e array<double>")
    with pytest.raises(Exception, match="each expert once"):
        oracle.oracle_labels_wide(df, ["a", "b"], {"mae": "e"}, ["sample_key"]).collect()


def test_experts_equal_their_plain_forms(ws):
    m = derived._season()
    x, h = F.col("x"), F.sequence(F.lit(1), F.col("pred_length"))
    ses = F.aggregate(F.slice(x, 2, 100), F.get(x, F.lit(0)), lambda s, v: F.lit(0.3) * v + F.lit(1 - 0.3) * s)
    want = {
        "last": F.transform(h, lambda _: F.element_at(x, -1)),
        "snaive": F.transform(h, lambda k: F.element_at(x, F.size(x) - m + F.pmod(k - 1, m).cast("int") + 1)),
        "ses": F.transform(h, lambda _: derived.on_grid(ses)),
    }
    rows = derived.simple_predictions(ws.windows().limit(500))
    expr = None
    for name, value in want.items():
        expr = F.when(F.col("model_name") == name, value) if expr is None else expr.when(F.col("model_name") == name, value)
    wrong = rows.filter(F.col("model_name").isin(list(want))).filter(F.col("y_pred") != expr)
    assert wrong.isEmpty() and rows.count() == 2500


def test_narrow_windows_from_wide_blocks(ws):
    panel = derived.scored(ws.panel())
    narrow = windows.cut_windows(panel, 5, 2, 16)
    wide = windows.open_blocks(windows.series_blocks(panel, 40, 64), 5, 2)
    assert narrow.exceptAll(wide).isEmpty() and wide.exceptAll(narrow).isEmpty()


def test_features_take_one_pass_over_arrow(ws):
    """All seventeen features in one call; no array lambdas, which run value by value outside generated code."""
    text = plan(features.build_features(ws.windows()))
    assert "aggregate(" not in text and len(re.findall(r"\bArrowEvalPython\b", text)) <= 2 * len(derived.CONFIGS)
    assert "aggregate(" not in plan(features.ar1_features(ws.windows()))


def test_periods_and_images_take_no_array_lambdas(ws):
    for df in (
        transforms.top_periods(ws.windows()),
        transforms.top_periods_dynamic(ws.windows()),
        transforms.imageize(ws.windows(), "top3fold", 4),
    ):
        assert "lambdafunction" not in plan(df)


def test_buckets_grow_with_the_windows(ws, monkeypatch):
    monkeypatch.setattr(derived, "POINTS", 500)
    monkeypatch.setattr(ws, "root", ws.root + "-small")
    wanted = -(-ws.points(ws.blocks()) // 500)
    assert wanted > 8 and len(ws.bucketed("labels").inputFiles()) == wanted  # one file a bucket
