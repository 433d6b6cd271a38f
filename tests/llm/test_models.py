"""Mixing, toxicity and the pipeline."""

import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from castwise.llm import mixing, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_rates_reach_targets(spark, larger):
    docs, labels = larger
    targets = {"good": 0.5, "poor": 0.45, "toxic": 0.05}
    got = mixing.mixing_rates(docs, mixing.label_domains(labels), targets).toPandas()
    assert len(got) == 1000 and (got.rate >= 0).all()
    shares = got[[f"p_{d}" for d in targets]]
    assert abs(shares.sum(axis=1) - 1).max() < 1e-9
    totals = shares.mul(got.rate * got.n_tokens, axis=0).sum() / got.n_tokens.sum()
    assert abs(totals.to_numpy() - list(targets.values())).max() < 1e-6
    assert (abs(got.copies - got.rate) < 1).all() and abs(got.copies.sum() - got.rate.sum()) < 0.1 * len(got)
    # the classifier knows the classes of labelled texts
    known = got.merge(mixing.label_domains(labels).toPandas(), on="doc_id")
    assert (known[["p_good", "p_poor"]].to_numpy().argmax(axis=1) == (known.domain == "poor"))[known.domain != "toxic"].mean() > 0.9


def test_rates_meet_the_bound(spark):
    """Targets out of reach: rates stop at zero and the rest is split by least squares."""
    rows = [(10, [1.0, 0.0])] * 5 + [(10, [0.5, 0.5])] * 5
    members = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    rated, reached = mixing.fit_rates(members, [0.2, 0.8])
    rates = sorted({round(r[0], 6) for r in rated.select("rate").collect()})
    assert rates[0] == 0.0 and len(rates) == 2
    # by hand: minimise (A r - T)' M^-1 (A r - T) over the rate of the mixed rows alone
    import numpy as np

    m = np.array([[62.5, 12.5], [12.5, 12.5]])
    w, a, t = np.linalg.inv(m), np.array([25.0, 25.0]), np.array([20.0, 80.0])
    assert abs(rates[1] - (a @ w @ t) / (a @ w @ a)) < 1e-2


def test_mixing_edges(made, spark):
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, "a"), (3, None), (4, "zz")], "doc_id long, domain string")
    table = made([(1, "x y z"), (2, "u v w"), (3, None), (4, ""), (None, "x u"), (2, "u v w"), (5, "x " * 50_000)])
    got = mixing.mixing_rates(table, labels, {"a": 1, "b": 1, "c": 0}).collect()
    assert len(got) == 7 and all(r.rate >= 0 for r in got)
    assert mixing.mixing_rates(table, labels.limit(0), {"a": 1, "b": 1}).count() == 7
    assert mixing.mixing_rates(table.limit(0), labels, {"a": 1, "b": 1}).count() == 0
    kept = mixing.mix(table, labels, {"a": 1, "b": 1})
    assert kept.columns == table.columns + ["mix_rate", "mix_copies"] and kept.count() <= 7


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out & got.toxic.notna()]
    bad, good = held[held.toxic == 1].score, held[held.toxic == 0].score
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.75 and (good < 0.5).mean() > 0.97 and (bad >= 0.5).mean() > 0.5


def test_toxicity_features():
    lexicon = {"fool": 2.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features("You f00l! You are a FOOL, yes", lexicon)))
    assert f["near_you"] > 0 and f["hidden_density"] > 0 and f["bang_rate"] > 0 and f["strongest"] == 2.0
    assert toxicity.features("", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_edges(made, spark):
    table = made([(1, None), (2, ""), (None, "words"), (3, "x " * 50_000), (3, "x " * 50_000)])
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(table, labels).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.0}
    assert toxicity.toxicity_scores(table.limit(0), labels.limit(0)).count() == 0


def test_pipeline(spark, larger):
    """Every stage takes what the last one kept; each decision shows in the rows."""
    docs, labels = larger
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        mine = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids is None or mine <= ids
        assert docs.columns[: len(columns)] == columns
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity_scores(before, labels).filter("predicted = 1").collect()}
            assert mine == {r.doc_id for r in before.collect()} - bad and bad
        if name == "line_dedup":
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
        if name == "mixing":
            assert docs.filter("mix_rate <= 0").count() == 0 and mine == ids
        ids = mine
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in docs.select("text").collect():
        flat = " ".join(r.text.lower().split())
        assert not any(item in flat for item in items)


def test_pipeline_on_empty_and_odd_tables(spark, made, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words", "en", "s", 10), (3, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9)]
    for k, rows in enumerate(([], odd)):
        folder = tmp_path / str(k)
        spark.createDataFrame(rows, columns).write.parquet(str(folder / "documents.parquet"))
        for name in ("labels", "benchmark"):
            spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(folder / f"{name}.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).select("doc_id").collect()
        assert {r.doc_id for r in got} == {r[0] for r in rows}
