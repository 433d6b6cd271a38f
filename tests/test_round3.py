"""Findings of round 3: the same results with less moved."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as reg
from castwise.operators import fusion, joins, keys, learn, transforms
from castwise.plans import derived, queries_fusion
from castwise.plans.workspace import workspace

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_routes_leave_no_row(spark):
    ws = workspace(spark, SF)
    routes = reg.queries()["j2_hard_route"](spark, SF)
    assert "Join" not in plan(routes)
    lab = keys.for_split(keys.for_metric(ws.labels(), "mae"), "test")
    joined = fusion.hard_route(ws.weights(), lab, derived.EXPERTS, derived.ROUTER_NAME)
    a, b = (df.toPandas().sort_values("sample_key").reset_index(drop=True) for df in (ws.routes(), joined))
    assert len(a) and list(a.columns) == list(b.columns) and a.equals(b)


def test_training_rows_without_join(spark):
    ws = workspace(spark, SF)
    mine = queries_fusion._vali(ws, "24_6_S")
    assert "Join" not in plan(mine)
    want = queries_fusion.training_rows(ws).filter("config_name = '24_6_S' AND split = 'vali'").select(*mine.columns)
    a, b = (df.toPandas().sort_values("sample_key").reset_index(drop=True) for df in (mine, want))
    flat = lambda v: np.concatenate([np.asarray(r, dtype=float) for r in v])
    assert len(a) and (a.sample_key == b.sample_key).all()
    for c in (*learn_inputs(), "y_true", "y_preds", "errors"):
        assert (flat([np.ravel(list(np.atleast_1d(v))) if c != "y_preds" else np.concatenate(list(v)) for v in a[c]])
                == flat([np.ravel(list(np.atleast_1d(v))) if c != "y_preds" else np.concatenate(list(v)) for v in b[c]])).all(), c


def learn_inputs():
    return queries_fusion.FEATURES


def test_packed_sums_are_those_of_rows(spark):
    rng = np.random.default_rng(1)
    rows = [
        ([float(v) for v in rng.normal(size=3)] + [0.1], [[float(v) for v in rng.normal(size=2)] for _ in range(2)],
         [float(v) for v in rng.normal(size=2)], [0.1, 0.4])
        for _ in range(learn.PACK + 7)
    ]
    data = spark.createDataFrame(rows, "x array<double>, y_preds array<array<double>>, y_true array<double>, errors array<double>").coalesce(1)
    blocks = learn.packed(data)
    assert blocks.count() == 2
    center, scale = learn._moments(blocks, 4)
    x = np.array([r[0] for r in rows])
    assert np.allclose(center, x.mean(axis=0)) and np.allclose(scale[:3], x.std(axis=0)[:3])
    assert (center[3], scale[3]) == (0.1, 1.0)  # a constant input
    net = learn.NetRouter(["a", "b"], center, scale, learn._initial([4, 2], 3))
    batch = learn._fusion_batch(center, scale, 0.1, 1.0, 0.2)
    a, b = (learn._evaluate(d, net, batch, learn._flat(net.params)) for d in (data, blocks))
    assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1])


def test_sample_join_labels_first_windows_alone(spark):
    joined = reg.queries()["f10_sample_join"](spark, SF)
    assert "RepartitionByExpression" not in plan(joined)  # the blocks of all series are not opened for labels
    assert joined.count() == 1000


def test_key_diff_in_one_aggregation(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "sample_key string")
    b = spark.createDataFrame([("y",), ("z",), (None,)], "sample_key string")
    diff = joins.key_diff(a, b)
    assert "Join" not in plan(diff)
    assert sorted((str(r[0]), r[1]) for r in diff.collect()) == [("None", "left"), ("None", "right"), ("x", "left"), ("z", "right")]


def test_image_means_are_those_of_the_pixels(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(str(i), [float(v) for v in rng.normal(size=n)]) for i, n in enumerate((24, 48, 24, 7))], "sample_key string, x array<double>")
    means = {(r.sample_key, r.variant): r.means for r in transforms.image_means(df, ["3view", "top3fold"], 5).collect()}
    for r in transforms.imageize(df, ["3view", "top3fold"], 5).collect():
        assert np.allclose(means[r.sample_key, r.variant], np.array(r.pixels).reshape(3, -1).mean(axis=1), atol=1e-6)
    assert len(means) == 8


def test_no_pixels_in_a_shuffle(spark):
    ws = workspace(spark, SF)
    shown = reg.queries()["d13_validate_images"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in shown
    assert reg.queries()["d10_image_values"](spark, SF).count() == ws.windows().select("config_name", "split").distinct().count()


def test_op4_batches_are_bounded():
    import pyarrow as pa

    from castwise.llm import lm

    text = " ".join(f"w{i}" for i in range(70_000))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([True]), pa.array([text])], ["block", "_id", "train", "_text"])
    for run in (lm._block_grams(3), lm._grams(3)):
        sizes = [b.num_rows for b in run(iter([batch]))]
        assert max(sizes) <= 1 << 16 and sum(sizes) == 70_001 + 70_000
