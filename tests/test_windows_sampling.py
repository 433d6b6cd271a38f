import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from castwise.operators import ordering, sampling, windows
from castwise.sources.panel import open_panel, panel_blocks, read_panel, scale_series, scaled_panel, split_steps

PANEL = "split string, dataset_name string, item_id long, channel_id int, pos int, value double"


def panel_of(spark, lengths):
    rng = np.random.default_rng(3)
    rows, values = [], {}
    for item, t in enumerate(lengths):
        v = rng.normal(size=t)
        values[item] = v
        rows += [("test", "d", item, 0, i, float(v[i])) for i in range(t)]
    return spark.createDataFrame(rows, PANEL), values


def test_cut_windows_matches_slices_for_any_length(spark):
    # no window, exactly one, a few, and a series far longer than a block
    panel, values = panel_of(spark, [6, 7, 11, 500])
    got = windows.cut_windows(panel, 5, 2, block=16).collect()
    want = {(i, w): v[w : w + 7] for i, v in values.items() for w in range(max(0, len(v) - 6))}
    assert len(got) == len(want)
    for r in got:
        w = want[(r.item_id, r.window_index)]
        assert r.x == pytest.approx(list(w[:5])) and r.y_true == pytest.approx(list(w[5:]))
    listed = {(r.item_id, r.window_index) for r in windows.enumerate_windows(panel, 5, 2, block=16).collect()}
    assert listed == set(want)


def test_windows_over_a_gap_are_left_out(spark):
    panel, values = panel_of(spark, [30])
    got = windows.with_history(panel.filter("pos <> 10"), 4, block=8).collect()
    want = {w for w in range(27) if not w <= 10 < w + 4}
    assert {r.window_index for r in got} == want


def test_read_panel_fills_gaps_and_scales(spark):
    ev = spark.createDataFrame([(1, 0, 2.0), (1, 0, 3.0), (1, 3, 7.0), (2, 1, 1.0)], "i long, s int, v double")
    p = read_panel(ev, "d", F.col("i"), F.col("s"), [F.col("v"), F.lit(1.0)], (0, 3))
    rows = {(r.item_id, r.channel_id, r.step): r.value for r in p.collect()}
    assert len(rows) == 2 * 2 * 4
    assert rows[(1, 0, 0)] == 5.0 and rows[(1, 1, 0)] == 2.0 and rows[(1, 0, 1)] == 0.0
    scaled = scale_series(split_steps(p.withColumnRenamed("value", "raw"), {"train": (0, 1), "test": (2, 3)}))
    got = {(r.item_id, r.channel_id, r.step): r.value for r in scaled.collect()}
    assert got[(1, 0, 0)] == pytest.approx(1.0, abs=1e-6)  # (5 - 2.5) / 2.5
    assert got[(1, 0, 3)] == pytest.approx((7 - 2.5) / 2.5, abs=1e-6)


def test_panel_is_filled_and_scaled_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(t), float(rng.integers(1, 9))) for i in range(6) for t in rng.integers(0, 50, 12)]
    rows += [(6, 0, 4.0), (6, 49, -0.0), (7, 20, None), (8, 7, 2.0), (8, 8, 3.0)]
    ev = spark.createDataFrame(rows, "i long, s int, v double")
    channels, bounds = [F.col("v"), F.lit(1.0)], {"train": (0, 20), "vali": (21, 30), "test": (31, 49)}
    want = {(i, c, t): 0.0 for i in range(9) for c in (0, 1) for t in range(50)}
    for i, t, v in rows:
        want[(i, 0, t)] += v or 0.0
        want[(i, 1, t)] += 1.0
    for block in (7, 50, 64):
        blocks, length = panel_blocks(ev, F.col("i"), F.col("s"), channels, block=block)
        long = open_panel(blocks, "d")
        assert length == 50 and {(r.item_id, r.channel_id, r.step): r.value for r in long.collect()} == want
        old = scale_series(split_steps(long.withColumnRenamed("value", "raw"), bounds))
        cols = ["item_id", "channel_id", "step", "split", "pos", "raw", "value"]
        assert sorted(scaled_panel(blocks, "d", bounds).select(*cols).collect()) == sorted(old.select(*cols).collect())
    # gaps are filled behind the last shuffle: only buckets with events are moved
    plan = read_panel(ev, "d", F.col("i"), F.col("s"), channels)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Generate", plan.index("Exchange")) == 0


def formula(n, count):
    return sorted({int(np.floor((k + 0.5) * n / count)) for k in range(count)})


def test_center_spacing_matches_formula(spark):
    cases = [(n, c) for n in (1, 2, 3, 7, 10, 61, 100) for c in (1, 2, 3, 5, 7, 10, 61) if c <= n]
    rows = [(f"{n}_{c}", i, c) for n, c in cases for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, c int")
    got = sampling.center_spaced(df, ["g"], ["i"], "c").toPandas().groupby("g").i.apply(sorted).to_dict()
    for n, c in cases:
        assert got[f"{n}_{c}"] == formula(n, c)
        pos = spark.range(1).select(sampling.center_positions(F.lit(n), F.lit(c)).alias("p")).first().p
        assert list(pos) == formula(n, c)


def test_center_spacing_wants_enough_rows(spark):
    with pytest.raises(Exception, match="more rows asked for"):
        sampling.center_spaced(spark.range(3), [], ["id"], 4).collect()


def quotas_by_hand(sizes, total):
    q = dict.fromkeys(sizes, 0)
    for _ in range(total):
        g = min((g for g in sizes if q[g] < sizes[g]), key=lambda g: (q[g], g))
        q[g] += 1
    return q


def test_balanced_quotas_match_handing_out_one_by_one(spark):
    rng = np.random.default_rng(0)
    cases = []
    for i in range(60):
        sizes = {f"g{j}": int(rng.integers(1, 9)) for j in range(int(rng.integers(1, 7)))}
        cases.append((i, sizes))
    total = 5
    cases = [(i, s) for i, s in cases if sum(s.values()) >= total]
    df = spark.createDataFrame([(i, g, n) for i, s in cases for g, n in s.items()], "case int, group_name string, size long")
    got = sampling.balanced_quotas(df, total, ["case"]).toPandas()
    for i, s in cases:
        mine = got[got.case == i].set_index("group_name").quota.to_dict()
        assert mine == quotas_by_hand(s, total)


def test_running_total_rank_and_median(spark):
    rng = np.random.default_rng(1)
    # one group holds most rows
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.8, "hot", "cold"), "k": rng.permutation(3000), "v": rng.integers(0, 40, 3000).astype(float)})
    df = spark.createDataFrame(pdf)
    got = ordering.with_running_total(df, ["k"], F.col("v"), ["g"], "t").toPandas().sort_values(["g", "k"])
    s = pdf.sort_values(["g", "k"])
    want = s.groupby("g").v.cumsum() - s.v
    assert np.allclose(got.t.to_numpy(), want.to_numpy())
    rank = ordering.with_rank(df, ["k"], (), "r").toPandas().sort_values("k")
    assert rank.r.tolist() == list(range(3000))
    med = ordering.exact_median(df, "v", ["g"], "m").toPandas().set_index("g").m.to_dict()
    assert med == pdf.groupby("g").v.median().to_dict()


def test_first_per_group_large_and_small(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    for n in (10, 1500):
        got = ordering.first_per_group(df, ["g"], ["k"], n).toPandas()
        assert got.groupby("g").k.max().tolist() == [2 * (n - 1), 2 * (n - 1) + 1] and len(got) == 2 * n


def test_cap_channels_wants_enough_channels(spark):
    df = spark.createDataFrame([("t", "d", 1, 0), ("t", "d", 1, 1), ("t", "d", 2, 0)], "split string, dataset_name string, item_id long, channel_id int")
    assert sampling.cap_channels(df, 1).count() == 2
    with pytest.raises(Exception, match="more channels asked for"):
        sampling.cap_channels(df, 2).collect()
