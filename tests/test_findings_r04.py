"""Findings of report r04: whole and right results, and the same results from less work."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as reg
from castwise.functions import spectral
from castwise.operators import incremental, ordering
from castwise.plans import derived
from castwise.plans.workspace import Workspace, workspace

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b) -> bool:
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_ranks_leave_columns_of_any_name_alone(spark):
    df = spark.range(50).select((F.lit(49) - F.col("id")).alias("_id"), F.lit("a").alias("_p"), F.lit("b").alias("_off"), F.lit(1).alias("_c"))
    got = ordering.with_rank(df, ["_id"]).collect()
    assert sorted((r["_id"], r["rank"]) for r in got) == [(i, i) for i in range(50)] and {(r["_p"], r["_off"], r["_c"]) for r in got} == {("a", "b", 1)}


def test_tables_belong_to_their_folder(spark):
    ws = Workspace(spark, SF)
    first = ws.series().count()
    ws.root += uuid.uuid4().hex
    assert ws.series().count() == first


def test_appended_rows_need_no_list_of_keys_on_the_driver(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "sample_key string, mean double, name string")
    existing, samples = rows(("a", 1.0, "x")), rows(*[(k, 0.0, "") for k in "abc"])
    batch = rows(("a", 9.0, "y"), ("b", 2.0, None), ("b", 2.0, None), ("c", None, "z"))
    out = incremental.append_new(existing, batch, samples)
    assert sorted(map(tuple, out.collect())) == [("a", 1.0, "x"), ("b", 2.0, None), ("c", None, "z")]
    assert "Broadcast" not in plan(out) and "Join" not in plan(out)
    for bad, said in ((("d", 1.0, ""), "not in the samples: d"), ((None, 1.0, ""), "not in the samples: null"), (("b", 3.0, None), "rows of one key differ: b")):
        with pytest.raises(Exception, match=said):
            incremental.append_new(existing, batch.unionByName(rows(bad)), samples).collect()


@pytest.mark.parametrize("name", ["q1_stream_ingest", "q3_stream_labels", "q6_stream_late_rows"])
def test_endless_states_are_in_rocksdb_and_triggers_use_all_tasks(spark, name, monkeypatch):
    from castwise.streaming import jobs

    seen = []
    for start in ("stream_ingest", "stream_labels"):
        inner = getattr(jobs, start)

        def noted(*args, inner=inner):
            query = inner(*args)
            query.awaitTermination()
            at = f"{args[4] if inner.__name__ == 'stream_labels' else args[3]}/offsets/0"
            provider = any("RocksDB" in r.value for r in spark.read.text(at).collect())
            seen.append((provider, max(p.sources[0].numInputRows for p in query.recentProgress)))
            return query

        monkeypatch.setattr(jobs, start, noted)
    reg.queries()[name](spark, SF).collect()
    assert seen and all(provider for provider, _ in seen)


def test_state_of_timed_labels_is_packed():
    import pandas as pd

    from castwise.streaming import jobs

    class Cell:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    class Handle:
        cell = Cell()

        def getListState(self, name, schema):
            assert schema == "piece binary"
            return self.cell

        def registerTimer(self, at):
            pass

    labels = jobs.TimedLabels(["a", "b"], 1000)
    labels.init(Handle())
    n = jobs.PIECE_SAMPLES + 5
    rows = pd.DataFrame({"sample_key": [f"k{i}" for i in range(n)], "expert": 0, "value": 1.5, "at_ms": 7})
    assert [len(out) for out in labels.handleInputRows((0,), iter([rows]), None)] == [0, 0]
    assert len(Handle.cell.rows) == 2 and len(labels._stored()) == n and labels._stored()["v1"].isna().all()
    label, late = labels.handleInputRows((0,), iter([rows.head(3).assign(expert=1, value=0.5)]), None)
    assert list(label.oracle_model) == ["b"] * 3 and late.empty and labels._stored()["done"].sum() == 3


def test_timed_labels_start_where_the_package_is_not_installed(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from castwise.streaming import jobs

    (tmp_path / "p").write_bytes(cloudpickle.dumps(jobs.TimedLabels(["a"], 1)))
    code = "import pickle, sys; sys.path = [p for p in sys.path if 'repo' not in p]; assert pickle.load(open('p', 'rb')).experts == ['a'] and 'castwise' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin"})


def odd_windows():
    rng = np.random.default_rng(4)
    steps = rng.normal(size=(300, 24)).cumsum(axis=1)
    spikes = np.where(rng.random((600, 24)) < rng.random((600, 1)) * 0.4, rng.integers(1, 5, (600, 24)), 0.0) / 3
    return np.vstack([steps, rng.normal(size=(300, 24)), spikes, np.zeros((2, 24)), np.arange(24.0)[None]])


def test_lags_are_chosen_as_by_a_regression_for_each(monkeypatch):
    """Most windows need no factor of their own: the regressions of all lags come from one pass over all windows."""
    m = odd_windows()
    taken = []
    nested = spectral._nested_ssr
    monkeypatch.setattr(spectral, "_nested_ssr", lambda x, y, first: taken.append(len(x)) or nested(x, y, first))
    got = spectral.is_stationary(m)
    assert sum(taken) < 400
    monkeypatch.setattr(spectral, "_ssr_by_lag", lambda d, level, lags: (np.empty((len(d), lags + 1)), np.zeros(len(d), dtype=bool)))
    assert (got == spectral.is_stationary(m)).all()
    d, level = np.diff(m[:600], axis=1), m[:600, :-1]
    monkeypatch.undo()
    ssr, sure = spectral._ssr_by_lag(d, level, 9)
    want, _ = spectral._nested_ssr(*spectral._lagged(d, level, 9), 2)
    assert sure.all() and np.allclose(ssr, want, rtol=1e-6)


@pytest.mark.parametrize("name", ["f6_fusion_input", "g5_oracle_labels", "j8_summarize_soft", "h10_compare_all_families", "k4_loss_gradient", "k8_model_table"])
def test_what_lies_in_a_windows_row_is_neither_joined_nor_stored(spark, name, monkeypatch):
    from castwise.plans import workspace as place

    ws = Workspace(spark, SF)
    ws.root += uuid.uuid4().hex
    monkeypatch.setitem(place._open, (spark.sparkContext.applicationId, SF), ws)
    df = reg.queries()[name](spark, SF)
    text = plan(df)
    assert not df.isEmpty() and "sample_key" not in " ".join(line for line in text.splitlines() if "Exchange" in line or "Join" in line)
    assert not {"features", "fusion_input", "routed", "forecasts"} & set(ws._schemas)


def test_all_features_are_made_and_returned(spark):
    import duckdb

    import check_queries as cq
    from castwise.plans.queries_windows import E8_SQL, SIXTEEN
    from castwise.plans.sqlbase import r6, with_tables

    got = reg.queries()["e8_build_features"](spark, SF)
    assert set(derived.FEATURES) <= set(got.columns)
    windows = workspace(spark, SF).windows().select("sample_key", "x").toPandas().set_index("sample_key").x
    flags = got.select("sample_key", "stationarity").toPandas().set_index("sample_key").stationarity
    for _, part in windows.groupby(windows.map(len)):
        want = spectral.is_stationary(np.stack(part.to_numpy()))
        assert 0 < want.mean() < 1 and (flags[part.index].round(3).to_numpy() == want).all()
    con = duckdb.connect()
    for t in cq.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    replaced = ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in SIXTEEN)
    want = con.execute(with_tables(f"SELECT * REPLACE ({replaced}) FROM ({E8_SQL})", None)).df()
    assert cq.compare(got.drop("stationarity").toPandas(), want) == ""
