"""Bad data stops the job instead of giving wrong numbers; axes come from the data."""

import pytest
from pyspark.sql import functions as F

from castwise.operators import audit, fusion, incremental, joins, oracle, ordering, sampling
from castwise.schemas import STABLE
from castwise.sources import tables
from castwise.sources.panel import read_panel, share_bounds, time_steps

FORECASTS = "sample_key string, model_name string, mae double, mse double"


def table(spark, rows):
    return spark.createDataFrame(rows, FORECASTS)


@pytest.mark.parametrize(
    "rows",
    [
        [("s", "a", 1.0, 1.0), ("s", "a", 7.0, 7.0), ("s", "b", 3.0, 3.0)],
        [("s", "a", 1.0, 1.0), ("s", "b", 3.0, 3.0), ("s", "other", 0.5, 0.5)],
        [("s", "a", 1.0, 1.0)],
    ],
)
def test_labels_want_each_expert_once(spark, rows):
    with pytest.raises(Exception, match="each expert once"):
        oracle.oracle_labels(table(spark, rows), ["a", "b"], keys=["sample_key"]).collect()


def test_matrix_refuses_repeats(spark):
    rows = [("s", "a", 1.0, 1.0), ("s", "a", 7.0, 7.0), ("s", "b", 3.0, 3.0)]
    with pytest.raises(Exception, match="repeated"):
        oracle.error_matrix(table(spark, rows), "mae", ["a", "b"], ["sample_key"]).collect()


def test_strict_join_refuses_fan_out(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2)], "sample_key string, u int")
    right = spark.createDataFrame([("k", 5)], "sample_key string, v int")
    for a, b in ((left, right), (right, left)):
        with pytest.raises(Exception, match="not one partner"):
            joins.strict_join(a, b, ["sample_key"]).collect()


def test_shards_that_disagree_do_not_merge(spark):
    samples = spark.createDataFrame([("s",)], "sample_key string")
    one, same, other = (table(spark, [("s", "a", v, v)]) for v in (1.0, 1.0, 5.0))
    assert incremental.merge_shards([one, same], samples).count() == 1
    with pytest.raises(Exception, match="differ"):
        incremental.merge_shards([one, other], samples).collect()


def test_append_takes_a_key_once_and_keeps_old_values(spark):
    kind = "sample_key string, mean double"
    samples = spark.createDataFrame([("a",), ("b",)], "sample_key string")
    old = spark.createDataFrame([("a", 1.0)], kind)
    batch = spark.createDataFrame([("a", 9.0), ("b", 2.0), ("b", 2.0)], kind)
    assert sorted(map(tuple, incremental.append_new(old, batch, samples).collect())) == [("a", 1.0), ("b", 2.0)]
    clash = spark.createDataFrame([("b", 2.0), ("b", 3.0)], kind)
    with pytest.raises(Exception, match="differ"):
        incremental.append_new(old, clash, samples).collect()


@pytest.mark.parametrize(
    "rows, said",
    [([("a", 1.0), ("a", 1.0)], "repeated"), ([("z", 1.0)], "not in the samples"), ([("a", float("nan"))], "not finite"), ([("a", None)], "not finite")],
)
def test_resume_refuses_bad_state(spark, rows, said):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_key string")
    done = spark.createDataFrame(rows, "sample_key string, mean double")
    with pytest.raises(Exception, match=said):
        incremental.checked_state(done, samples, ["mean"]).collect()
    good = spark.createDataFrame([("b", 0.5)], "sample_key string, mean double")
    assert incremental.checked_state(good, samples, ["mean"]).collect() == good.collect()


def test_axis_holds_every_event(spark):
    events = spark.createDataFrame([(1, -40, 2.0), (1, 500, 3.0), (2, 7, 4.0), (2, None, 9.0)], "i long, s int, v double")
    panel = read_panel(events, "d", F.col("i"), F.col("s"), [F.col("v")])
    assert panel.agg(F.sum("value")).first()[0] == 9.0
    assert panel.agg(F.min("step"), F.max("step"), F.count("*")).first()[:] == (0, 540, 2 * 541)
    assert share_bounds(7, {"train": 2, "vali": 1, "test": 1}) == {"train": (0, 2), "vali": (3, 3), "test": (4, 6)}


def test_round_robin_default_order_knows_configs(spark):
    rows = [(c, "vali", "d", 1, 0, w) for c in ("c1", "c2") for w in range(4)]
    df = spark.createDataFrame(rows, "config_name string, split string, dataset_name string, item_id long, channel_id int, window_index int")
    shards = [r["shard"] for r in sampling.shard_round_robin(df, 8).collect()]
    assert sorted(shards) == list(range(8))


def test_first_per_group_has_one_plan(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    for n in (1, 3, 1500):
        got = ordering.first_per_group(df, ["g"], ["id"], n).groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
        assert {(r.g, r.n, r.m) for r in got} == {(0, n, 2 * n - 2), (1, n, 2 * n - 1)}


def test_strategy_names():
    names = [s.name for s in fusion.strategies([0.5, 1.0], [None, 1, 2])]
    assert names == ["soft_T0p5", "raw_soft", "top1_hard", "top2_fusion_T0p5", "top2_fusion"]
    with pytest.raises(ValueError):
        fusion.strategies([0.0])


SHARD = "sample_key string, model_name string, config_name string, y_true array<double>, y_pred array<double>"


def shard(spark, rows):
    return spark.createDataFrame(rows, SHARD)


GOOD = [("s", "a", "c", [1.0], [2.0]), ("t", "a", "c", [3.0], [2.0])], [("s", "b", "c", [1.0], [0.0]), ("t", "b", "c", [3.0], [0.0])]


@pytest.mark.parametrize(
    "rows, said",
    [
        ([("s", "b", "c", [1.5], [0.0]), ("t", "b", "c", [3.0], [0.0])], "truth differs: s"),
        ([("s", "b", "c", [1.0], [0.0]), ("t", "b", "d", [3.0], [0.0])], "metadata differ: t"),
        ([("s", "b", "c", [1.0], [0.0])], "an expert is missing: t"),
        ([*GOOD[1], ("s", "z", "c", [1.0], [0.0])], "an expert is unknown: s"),
        ([*GOOD[1], ("s", "b", "c", [1.0], [9.0])], "rows of one expert differ: s"),
    ],
)
def test_bad_shards_stop_the_merge(spark, rows, said):
    samples = spark.createDataFrame([("s", "c"), ("t", "c")], "sample_key string, config_name string")
    with pytest.raises(Exception, match=said):
        incremental.merge_shards([shard(spark, GOOD[0]), shard(spark, rows)], samples, ["a", "b"]).collect()
    bad = shard(spark, [*GOOD[0], *rows])
    report = {r.check: r.violations for r in incremental.merge_report(bad, "a", ["a", "b"]).collect()}
    assert sum(report.values()) == 1


def test_merge_drops_foreign_and_repeated_rows(spark):
    parts = [shard(spark, [*GOOD[0], GOOD[0][0], ("x", "a", "c", [9.0], [9.0])]), shard(spark, GOOD[1])]
    samples = spark.createDataFrame([("s", "c"), ("t", "c")], "sample_key string, config_name string")
    got = sorted(map(tuple, incremental.merge_shards(parts, samples, ["a", "b"]).collect()))
    assert got == sorted(GOOD[0] + GOOD[1])
    assert incremental.merge_shards([shard(spark, p) for p in GOOD], samples).count() == 4
    other = spark.createDataFrame([("s", "c"), ("t", "other")], "sample_key string, config_name string")
    with pytest.raises(Exception, match="metadata differ: t"):
        incremental.merge_shards([shard(spark, p) for p in GOOD], other).collect()


def test_redo_leaves_files_of_complete_groups(spark, tmp_path):
    kind = "sample_key string, g string, v double"
    rows = [(f"{g}{i}", g, float(i)) for g in "abc" for i in range(4)]
    all_rows = spark.createDataFrame(rows, kind)
    path = str(tmp_path / "t")
    held = all_rows.filter("NOT (g = 'b' AND v > 1) AND g <> 'c'").withColumn("v", F.col("v") + 100)
    tables.write_table(held, path, ["g"], files=1)

    def files(g):
        return {(f.name, f.stat().st_mtime_ns) for f in (tmp_path / "t" / f"g={g}").glob("*.parquet")}

    before, stored = files("a"), spark.read.schema(kind).parquet(path).select("sample_key", "g", "v")
    redone = incremental.redo_partial(stored, path, all_rows.select("sample_key", "g"), lambda todo: all_rows.join(todo.select("sample_key"), "sample_key"), ["g"])
    assert sorted({r.g for r in redone.collect()}) == ["b", "c"] and files("a") == before and len(files("b")) == 1
    got = {r.sample_key: r.v for r in spark.read.schema(kind).parquet(path).collect()}
    assert got == {k: v + (100 if g == "a" else 0) for k, g, v in rows}
    stored = spark.read.schema(kind).parquet(path).select("sample_key", "g", "v")
    with pytest.raises(Exception, match="not one partner"):  # a build that loses a key
        incremental.redo_partial(stored.filter("g <> 'c'"), path, all_rows.select("sample_key", "g"), lambda todo: all_rows.filter("v > 0"), ["g"])
    with pytest.raises(ValueError, match="no samples"):
        incremental.redo_partial(stored, path, all_rows.filter("g <> 'a'"), lambda todo: all_rows, ["g"])


def test_bucketed_fusion_has_no_exchange(spark, tmp_path):
    experts, n = ["a", "b"], 40
    base = spark.range(n).select(F.concat(F.lit("s"), "id").alias("sample_key"), *[F.lit("x").alias(c) for c in STABLE[1:]], F.col("id").cast("double").alias("f"))
    labels = base.withColumns({"oracle_model": F.lit("a"), "oracle_value": F.lit(1.0), "a": F.lit(1.0), "b": F.lit(2.0)}).drop("f")
    forecasts = base.select("sample_key", F.explode(F.array(*[F.lit(e) for e in experts])).alias("model_name"), F.array("f").alias("y_true"), F.array("f").alias("y_pred"))

    def stored(df, name):
        name = f"t_{name}_{tmp_path.name}"
        tables.write_bucketed(df, name, str(tmp_path / name), ["sample_key"], 4)
        assert len(list((tmp_path / name).glob("*.parquet"))) == 4
        return spark.table(name)

    few = stored(base.filter("f < 5"), "few")
    f, lab, fc = stored(base, "f"), stored(labels, "l"), stored(forecasts, "fc")
    wide = joins.fusion_input(f, lab, fc, experts, ["f"], bucketed=True)
    plain = joins.fusion_input(base, labels, forecasts, experts, ["f"])
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, plain.select(*wide.columns).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables
    try:
        large = joins.fusion_input(f, lab, fc, experts, ["f"], bucketed=True)
        plan = large._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    for args in ((few, lab, fc), (f, lab.filter("sample_key <> 's3'"), fc), (f, lab, fc.filter("sample_key <> 's3'"))):
        with pytest.raises(Exception, match="not one partner"):
            joins.fusion_input(*args, experts, ["f"], bucketed=True).collect()


CURVE = "model string, config_name string, epoch int, validation_mse double, validation_mae double"
FILES = "model string, config_name string, path string, modified long"


def test_best_checkpoint(spark):
    curve = spark.createDataFrame([("m", "c", e, mse, mae) for e, mse, mae in ((0, 3.0, 1.0), (1, 1.0, 3.0), (2, 2.0, 2.0), (3, 2.0, 2.0))], CURVE)

    def files(*names):
        return spark.createDataFrame([("m", "c", f"r/checkpoints/{n}", k) for k, n in enumerate(names)], FILES)

    saved = ["ckpt_epoch=0_step=9_x.ckpt", "ckpt_epoch=2_step=9_x.ckpt", "ckpt_epoch=3_step=9_x.ckpt", "best_epoch=2_step=9_x.ckpt", "best_epoch=0_step=9_x.ckpt", "notes.txt"]
    r = audit.best_checkpoint(curve, files(*saved)).first()
    # epoch 1 has no checkpoint; 2 and 3 are equal
    assert (r.epoch_count, r.mse_best_epoch, r.mae_best_epoch, r.mse_best_differs_from_mae_best) == (3, 2, 0, True)
    assert r.checkpoint_path.endswith("ckpt_epoch=2_step=9_x.ckpt")
    alone = audit.best_checkpoint(curve, files("ckpt_epoch=0_step=9_x.ckpt")).first()
    assert alone.mae_best_epoch is None and alone.mse_best_differs_from_mae_best
    with pytest.raises(Exception, match="without a point on the curve: m c 7"):
        audit.best_checkpoint(curve, files(*saved, "ckpt_epoch=7_step=9_x.ckpt")).collect()
    with pytest.raises(Exception, match="no checkpoint with a curve: m c"):
        audit.best_checkpoint(curve, files("best_epoch=2_step=9_x.ckpt")).collect()


def test_matrix_refuses_unknown_experts(spark):
    rows = [("s", "a", 1.0, 1.0), ("s", "z", 3.0, 3.0)]
    with pytest.raises(Exception, match="unknown expert"):
        oracle.error_matrix(table(spark, rows), "mae", ["a", "b"], ["sample_key"]).collect()


def test_time_buckets(spark):
    df = spark.sql("SELECT timestamp '1970-01-01 03:59:59' AS t, date '1970-01-06' AS d")
    steps = [time_steps(F.col(c), b) for c, b in (("t", "2 hours"), ("t", "30 minutes"), ("d", "1 day"), ("d", "1 week"), ("t", "1 week"))]
    assert list(df.select(*steps).first()) == [1, 7, 5, 0, -1]
    events = spark.createDataFrame([(1, 2.0)], "i long, v double").withColumn("t", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    panel = read_panel(events, "d", F.col("i"), None, [F.col("v")], time=F.col("t"), bucket="1 hour")
    assert [(r.step, r.value) for r in panel.collect()] == [(0, 2.0)]
    with pytest.raises(ValueError):
        read_panel(events, "d", F.col("i"), None, [F.col("v")])


def test_label_keys_meet_without_an_aggregation_and_shards_have_even_files(spark, tmp_path):
    from castwise.sources import tables

    rows = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("sample_key"), F.lit("mae").alias("metric"))
    rows.write.parquet(str(tmp_path / "labels"))
    keys = rows.filter("sample_key < 'k2'")
    got = tables.read_labels(spark, str(tmp_path / "labels"), ["a"], "mae", keys.unionByName(keys))
    assert got.count() == keys.count() and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    index = tables.write_sharded(rows, str(tmp_path / "shards"), 4, files=4)
    assert index.agg(F.sum("row_count")).first()[0] == 4000
    # the hash that deals files is independent of that of the shards
    spread = rows.groupBy(F.pmod(F.xxhash64("sample_key"), F.lit(4)), F.pmod(F.xxhash64(F.lit("file"), "sample_key"), F.lit(4))).count().collect()
    assert len(spread) == 16 and min(r["count"] for r in spread) > 150
