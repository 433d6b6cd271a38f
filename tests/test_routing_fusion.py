import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwise.operators import fusion, joins, learn, oracle, routing, validate
from castwise.operators.forecasts import make_forecasts, score_forecasts
from castwise.schemas import FORECASTS_SCHEMA, STABLE

EXPERTS = ["a", "b", "c"]


def key(config, split, item, w):
    return f"{config}__{split}__d__item{item}__ch0__win{w}"


def forecast_rows(spark, errors):
    """errors: {(config, split, item, window): [error of a, b, c]}; horizon 2, truth 0."""
    rows = []
    for (config, split, item, w), es in errors.items():
        for name, e in zip(EXPERTS, es):
            rows.append(
                ("v", key(config, split, item, w), config, split, "d", item, 0, w, 4, 2, name, "x", "y", [0.0, 0.0], [float(e), -float(e)], abs(float(e)), float(e) ** 2)
            )
    return spark.createDataFrame(rows, FORECASTS_SCHEMA)


def test_oracle_ties_go_to_the_earlier_expert(spark):
    f = forecast_rows(spark, {("c1", "vali", 1, 0): [2, 2, 2], ("c1", "vali", 1, 1): [3, 1, 1]})
    got = {(r.window_index, r.metric): r for r in oracle.oracle_labels(f, EXPERTS).collect()}
    assert got[(0, "mae")].oracle_model == "a" and got[(1, "mse")].oracle_model == "b"
    assert got[(1, "mse")].a_regret == 8.0 and got[(1, "mae")].oracle_top1_value == 1.0


def test_missing_expert_and_unequal_lengths_fail(spark):
    f = forecast_rows(spark, {("c1", "vali", 1, 0): [1, 2, 3]})
    with pytest.raises(Exception, match="each expert once"):
        oracle.oracle_labels(f.filter("model_name <> 'b'"), EXPERTS).collect()
    short = f.withColumn("y_pred", F.slice("y_pred", 1, 1))
    with pytest.raises(Exception, match="differ in length"):
        score_forecasts(short).collect()
    with pytest.raises(Exception, match="unknown split"):
        make_forecasts(f.withColumn("split", F.lit("train"))).collect()
    with pytest.raises(Exception, match="do not fit"):
        joins.stack_experts(f.filter("model_name <> 'b'"), EXPERTS).collect()


def labels_with_cells(spark):
    f = forecast_rows(
        spark,
        {
            ("c1", "vali", 1, 0): [1, 2, 9],
            ("c1", "vali", 1, 1): [1, 2, 9],
            ("c1", "vali", 2, 0): [9, 1, 5],
            ("c1", "test", 1, 0): [4, 1, 2],
            ("c1", "test", 2, 0): [4, 1, 2],
            ("c1", "test", 3, 0): [4, 6, 5],
        },
    )
    lab = oracle.oracle_labels(f, EXPERTS).filter("metric = 'mae'")
    cell = F.when(F.col("item_id") == 1, "x").when(F.col("item_id") == 2, "y").otherwise("unseen")
    return lab.withColumn("cluster", F.lit(0)).withColumn("group_name", cell)


def test_rules_and_fallback_for_unseen_groups(spark):
    lab = labels_with_cells(spark)
    got = {(r.baseline, r.item_id): r for r in routing.baseline_suite(lab, EXPERTS).collect()}
    # vali means: a 11/3, b 5/3, c 23/3 -> b; wins: a 2, b 1 -> a
    assert got[("global_best_single", 1)].selected_model == "b"
    assert got[("global_majority_label", 1)].selected_model == "a"
    assert got[("tsf_cell_only", 1)].selected_model == "a" and got[("tsf_cell_only", 2)].selected_model == "b"
    assert got[("tsf_cell_majority_label", 3)].selected_model == "b"  # falls back to the mean-best expert
    assert got[("oracle_top1", 3)].selected_model == "a" and got[("oracle_top1", 3)].regret_to_oracle == 0
    assert len(got) == 27
    one = routing.fit_rule(lab, ["group_name"], "mean_metric_best", EXPERTS)
    fallback = routing.fit_rule(lab, [], "mean_metric_best", EXPERTS)
    single = {r.item_id: r.selected_model for r in routing.apply_rule(lab, one, ["group_name"], fallback, EXPERTS).collect()}
    assert single == {i: got[("tsf_cell_only", i)].selected_model for i in (1, 2, 3)}


def test_oracle_bounds_every_rule(spark):
    s = routing.summarize_routing(routing.baseline_suite(labels_with_cells(spark), EXPERTS), [["config_name"]]).toPandas()
    best = s[s.baseline == "oracle_top1"].selected_value.iloc[0]
    assert (s.selected_value >= best).all() and (s.regret_to_oracle >= 0).all()


def test_strict_join_and_enrich_fail_on_unmatched_rows(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "sample_key string, u int")
    b = spark.createDataFrame([("k1", 5)], "sample_key string, v int")
    with pytest.raises(Exception, match="not one partner"):
        joins.strict_join(a, b, ["sample_key"]).collect()
    assert joins.strict_join(a.limit(1), b, ["sample_key"]).first().v == 5
    items = spark.createDataFrame([(1, "old"), (2, "old")], "item_id long, group_name string")
    regimes = spark.createDataFrame([(1, "new")], "item_id long, group_name string")
    with pytest.raises(Exception, match="no regime"):
        joins.enrich(items, regimes).collect()
    kept = {r.item_id: r.group_name for r in joins.enrich(items, regimes, missing="keep").collect()}
    assert kept == {1: "new", 2: None}


def weights(spark, *rows):
    return spark.createDataFrame([(list(map(float, r)),) for r in rows], "weights array<double>")


def test_calibration_edges(spark):
    def run(w, t, k):
        return fusion.calibrate(weights(spark, w), t, k, EXPERTS).first().weights

    raw = [0.2, 0.5, 0.3]
    assert run(raw, 1.0, None) == pytest.approx(raw)
    assert run(raw, 1.0, 3) == pytest.approx(raw)
    assert run(raw, 0.25, 1) == pytest.approx([0, 1, 0])
    assert run([0.4, 0.2, 0.4], 2.0, 1) == pytest.approx([1, 0, 0])  # tie: expert order
    p = np.array(raw) ** 2
    assert run(raw, 0.5, None) == pytest.approx(p / p.sum())
    assert run(raw, 0.5, 2) == pytest.approx([0, p[1] / (p[1] + p[2]), p[2] / (p[1] + p[2])])


def test_default_grid_has_nineteen_strategies():
    names = [s.name for s in fusion.strategies()]
    assert len(names) == 19 and len(set(names)) == 19
    assert "raw_soft" in names and "top1_hard" in names and "soft_T0p25" in names and "top2_fusion_T1p5" in names


def test_sweep_agrees_with_numpy_soft_and_hard(spark):
    rng = np.random.default_rng(0)
    errors = {("c1", "test", i, 0): list(rng.uniform(0.1, 3, 3)) for i in range(6)}
    f = forecast_rows(spark, errors)
    lab = oracle.oracle_labels(f, EXPERTS).filter("metric = 'mae'")
    w = {key(*k): rng.dirichlet([1, 1, 1]) for k in errors}
    rows = f.select(*STABLE).distinct().collect()
    wdf = spark.createDataFrame([(*r, [float(v) for v in w[r.sample_key]]) for r in rows], f.select(*STABLE).schema.add("weights", T.ArrayType(T.DoubleType())))
    routed = fusion.hard_route(wdf, lab, EXPERTS, "r")
    swept = fusion.sweep(routed, f, EXPERTS, "mae").toPandas()
    soft = fusion.soft_fuse(routed, f, EXPERTS).toPandas().set_index("sample_key")
    for k, es in errors.items():
        mine = swept[swept.sample_key == key(*k)].set_index("strategy_name")
        ww = w[key(*k)]
        assert mine.loc["raw_soft", "mae"] == pytest.approx(ww @ np.array(es))
        assert mine.loc["raw_soft", "mse"] == pytest.approx((ww @ np.array(es)) ** 2)
        assert mine.loc["top1_hard", "mae"] == pytest.approx(es[int(np.argmax(ww))])
        q = ww**2 * (np.argsort(np.argsort(-ww)) < 2)
        assert mine.loc["top2_fusion_T0p5", "mae"] == pytest.approx(q @ np.array(es) / q.sum())
        assert soft.loc[key(*k), "soft_fusion_mae"] == pytest.approx(mine.loc["raw_soft", "mae"])
        assert soft.loc[key(*k), "hard_top1_mae_from_array"] == pytest.approx(mine.loc["top1_hard", "mae"])
    assert len(swept) == 6 * 19


def test_integrity_report_counts_each_fault(spark):
    good = forecast_rows(spark, {("c1", "test", i, w): [1, 2, 3] for i in range(2) for w in range(8)})
    assert validate.integrity_report(good, EXPERTS).first().passed
    at = lambda w, m: (F.col("window_index") == w) & (F.col("model_name") == m)
    bad = good.unionByName(good.filter(at(0, "a"))).filter(~at(1, "c"))
    bad = (
        bad.withColumn("pred_length", F.when(at(2, "a"), 3).otherwise(F.col("pred_length")))
        .withColumn("y_true", F.when(at(3, "a"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.col("y_true")))
        .withColumn("y_pred", F.when(at(4, "a"), F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.col("y_pred")))
        .withColumn("sample_key", F.when(F.col("window_index") == 5, F.concat("sample_key", F.lit("!"))).otherwise(F.col("sample_key")))
    )
    r = validate.integrity_report(bad, EXPERTS).first()
    assert (r.duplicate_forecasts, r.incomplete_samples, r.unstable_samples, r.inconsistent_truth) == (2, 2, 2, 2)
    assert r.bad_arrays == 4 and r.bad_keys == 6 and not r.passed  # wrong length and NaN; three rows per renamed sample
    with pytest.raises(ValueError, match="integrity"):
        validate.require_passed(validate.integrity_report(bad, EXPERTS))


def test_fusion_gradient_matches_differences():
    rng = np.random.default_rng(4)
    params = learn._initial([3, 4, 3], 1)
    x, preds, true = rng.normal(size=(5, 3)), rng.normal(size=(5, 3, 2)), rng.normal(size=(5, 2))
    q = rng.dirichlet([1, 1, 1], 5)
    grads, _ = learn._fusion_gradient(params, x, preds, true, q, 0.5, 0.3)
    for p, g in zip(params, grads):
        i = tuple(0 for _ in p.shape)
        keep = p[i]
        p[i] = keep + 1e-6
        _, up = learn._fusion_gradient(params, x, preds, true, q, 0.5, 0.3)
        p[i] = keep - 1e-6
        _, down = learn._fusion_gradient(params, x, preds, true, q, 0.5, 0.3)
        p[i] = keep
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_fusor_learns_and_model_table_guards_settings(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(200):
        u = float(rng.normal())
        good = 0 if u > 0 else 2
        preds = [[1.0 + 3 * (i != good)] * 2 for i in range(3)]
        rows.append(([u, 1.0], preds, [1.0, 1.0], [3.0 * (i != good) for i in range(3)]))
    data = spark.createDataFrame(rows, "x array<double>, y_preds array<array<double>>, y_true array<double>, errors array<double>")
    net = learn.fit_fusion_router(data, EXPERTS, 2, epochs=12, lr=0.3)
    assert net.history[-1] < 0.7 * net.history[0]
    w = learn.score_net(net, data.select("x"), [], "x").toPandas().weights
    assert np.allclose([sum(v) for v in w], 1.0)
    learn.save_model(spark, net, {"lr": 0.3}, str(tmp_path / "m"))
    again = learn.load_model(spark, str(tmp_path / "m"), {"lr": 0.3})
    assert np.allclose(again.params[0], net.params[0])
    with pytest.raises(ValueError, match="settings differ"):
        learn.load_model(spark, str(tmp_path / "m"), {"lr": 0.1})


def test_training_goes_on_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(list(map(float, x)), int(x[0] > 0) + int(x[1] > 1), 1.0) for x in rng.normal(size=(60, 3))]
    data = spark.createDataFrame(rows, "x array<double>, label int, class_weight double").cache()
    path, sign = str(tmp_path / "m"), {"lr": 0.1}
    six = learn.fit_class_router(data, ["a", "b", "c"], 3, hidden=4, epochs=6, lr=0.1)
    learn.save_model(spark, learn.fit_class_router(data, ["a", "b", "c"], 3, hidden=4, epochs=3, lr=0.1), sign, path)
    more = learn.fit_class_router(data, ["a", "b", "c"], 3, epochs=3, lr=0.1, resume=learn.load_model(spark, path, sign))
    assert more.steps == 6 and np.allclose(more.history, six.history, atol=1e-12)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(more.params, six.params))
    with pytest.raises(ValueError, match="settings differ"):
        learn.load_model(spark, path, {"lr": 0.2})


def test_training_ends_by_its_gradient(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    label = (x @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=80) > 0).astype(int)
    data = spark.createDataFrame([(list(map(float, r)), int(k), 1.0) for r, k in zip(x, label)], "x array<double>, label int, class_weight double").cache()
    net = learn.fit_class_router(data, ["a", "b"], 3, hidden=0, epochs=100, decay=0.01, tol=1e-7)
    assert net.converged and net.gradient_norm <= 1e-7 and net.history[-1] == min(net.history)
    # the optimum of the same penalised loss, by Newton steps
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    z, t = np.column_stack([z, np.ones(80)]), np.zeros(4)
    for _ in range(30):  # two softmax rows a and -a: penalty 0.01 * a^2 on the difference d = 2a
        p = 1 / (1 + np.exp(-z @ t))
        t -= np.linalg.solve((z.T * (p * (1 - p))) @ z / 80 + 0.005 * np.eye(4), z.T @ (p - label) / 80 + 0.005 * t)
    w, b = net.params
    assert np.allclose(np.append(w[:, 1] - w[:, 0], b[1] - b[0]), t, atol=1e-5)
    short = learn.fit_class_router(data, ["a", "b"], 3, hidden=0, epochs=1, decay=0.01, tol=1e-7)
    assert not short.converged and short.steps == 1


def test_gradient_is_the_slope_of_the_loss(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), rng.normal(size=(2, 3)).tolist(), rng.normal(size=3).tolist(), rng.random(2).tolist()) for a, b in rng.normal(size=(20, 2))]
    data = spark.createDataFrame(rows, "f double, g double, y_preds array<array<double>>, y_true array<double>, errors array<double>").cache()
    router = learn.LinearRouter(["a", "b"], ["f", "g"], [0.1, 0.0], [1.0, 2.0], [[0.3, -0.2], [0.1, 0.4]], [0.0, 0.2])

    def at(step):
        moved = learn.replace(router, coef=[[0.3 + step, -0.2], [0.1, 0.4]])
        return {(r.expert, r.input): r for r in learn.fusion_gradient(data, moved, 0.5, 0.5, 0.1).collect()}

    up, down, here = at(1e-5), at(-1e-5), at(0.0)
    slope = (up["a", "f"].loss - down["a", "f"].loss) / 2e-5
    assert abs(slope - here["a", "f"].gradient) < 1e-7 and len(here) == 6


def test_gradient_of_the_hidden_layer():
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(size=(9, 3)), rng.integers(0, 2, 9), rng.random(9)
    params = learn._initial([3, 4, 2], 1)
    theta, shapes = learn._flat(params), [p.shape for p in params]
    grads, _ = learn._class_gradient(params, x, y, w)
    for i, g in enumerate(learn._flat(grads)):
        step = np.eye(len(theta))[i] * 1e-6
        up, down = (learn._class_gradient(learn._unflatten(theta + s, shapes), x, y, w)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - g) < 1e-6
