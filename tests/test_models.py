"""Property tests for model-based operators (R rows): determinism, value
ranges, planted signal, recovered label flips, save/load identity."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import noise as N
from tessera.operators import train as TR
from tessera.operators.prep import Preprocessor, PreprocessorModel
from tessera.operators.split import split


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 600
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (x1 + 0.5 * x2 > 0).astype(int)
    flipped = rng.choice(n, size=30, replace=False)
    y_noisy = y.copy()
    y_noisy[flipped] = 1 - y_noisy[flipped]
    pdf = pd.DataFrame({"k": np.arange(n), "x1": x1, "x2": x2, "x3": x3, "y": y_noisy,
                        "r": 3 * x1 - 2 * x2 + 0.1 * rng.normal(size=n)})
    return spark.createDataFrame(pdf), set(int(i) for i in flipped)


def test_split_is_deterministic_and_disjoint(spark, planted):
    df, _ = planted
    a1, b1 = split(df, "k", 0.25)
    a2, b2 = split(df.repartition(7), "k", 0.25)
    ka1 = {r["k"] for r in a1.collect()}
    kb1 = {r["k"] for r in b1.collect()}
    assert ka1 == {r["k"] for r in a2.collect()} and kb1 == {r["k"] for r in b2.collect()}
    assert not ka1 & kb1 and len(ka1) + len(kb1) == 600
    _tr, te = split(df, "k", 0.25, stratify="y")
    counts = {r["y"]: r["count"] for r in te.groupBy("y").count().collect()}
    total = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert all(counts[c] == math.ceil(0.25 * total[c]) for c in total)


def test_classifiers_beat_majority(spark, planted):
    df, _ = planted
    tr, te = split(df, "k", 0.25)
    res, best, models = TR.train_classification(
        tr, te, "y", ["x1", "x2", "x3"], ["logistic_regression", "naive_bayes", "decision_tree", "svm"])
    rows = {r["model"]: r for r in res.collect()}
    majority = max(te.groupBy("y").count().collect(), key=lambda r: r["count"])["count"] / te.count()
    assert rows["logistic_regression"]["accuracy"] > majority + 0.1
    assert all(0.0 <= r["roc_auc"] <= 1.0 for r in rows.values())
    assert best in rows


def test_probabilities_and_prediction_output(spark, planted):
    df, _ = planted
    labelled, classes = TR.index_label(df, "y")
    model = TR.fit_model(labelled, ["x1", "x2"], "logistic_regression")
    out = TR.predict(model, df, classes, keys=["k"]).collect()
    assert all(0.0 <= r["probability_pct"] <= 100.0 for r in out)
    assert {r["predicted_class"] for r in out} <= {"0", "1"}


def test_regressors_and_importance(spark, planted):
    df, _ = planted
    tr, te = split(df.drop("y"), "k", 0.2)
    res, best, models = TR.train_regression(tr, te, "r", ["x1", "x2", "x3"], ["linear_regression", "svr"])
    r2 = {r["model"]: r["r2"] for r in res.collect()}
    assert r2["linear_regression"] > 0.95
    imp = TR.feature_importance(models["linear_regression"], ["x1", "x2", "x3"], spark).collect()
    assert imp[0]["feature"] == "x1"
    ti = TR.tree_importance(df.drop("y", "k"), "r", k=2).collect()
    assert math.isclose(sum(r["score"] for r in ti), 1.0, abs_tol=1e-3)
    assert {r["feature"] for r in ti if r["selected"]} == {"x1", "x2"}


def test_rfe_keeps_signal(spark, planted):
    df, _ = planted
    out = TR.rfe(df.drop("y", "k"), "r", k=2, est="forest", n_trees=20).collect()
    assert {r["feature"] for r in out if r["selected"]} == {"x1", "x2"}


def test_label_flips_found_better_than_chance(spark, planted):
    df, flipped = planted
    review, report = N.detect_label_noise(df.drop("r"), "y", keys="k", n_trees=50)
    found = {r["k"] for r in review.collect()}
    rep = report.first()
    assert rep["noisy_rows"] == len(found)
    precision = len(found & flipped) / max(len(found), 1)
    assert precision > 30 / 600 * 3          # well above the base rate of flips


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    x[:10] += 8
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(500), "a": x[:, 0], "b": x[:, 1]}))
    review, report = N.detect_anomalies(df, ["a", "b"], "k", contamination=0.05, n_trees=50, top=None)
    found = {r["k"] for r in review.collect()}
    assert set(range(10)) <= found
    again = {r["k"] for r in N.detect_anomalies(df, ["a", "b"], "k", contamination=0.05, n_trees=50,
                                                top=None)[0].collect()}
    assert found == again


def test_preprocessor_replay_and_save_load(spark, tmp_path):
    pdf = pd.DataFrame({"k": range(40), "num": [float(i % 7) if i % 9 else None for i in range(40)],
                        "cat": [["a", "b", "c"][i % 3] if i % 11 else None for i in range(40)],
                        "y": [i % 2 for i in range(40)]})
    df = spark.createDataFrame(pdf)
    model, out = Preprocessor({"target": "y", "scaling": "standard"}).fit_transform(df)
    assert "y" in out.columns and out.where("num IS NULL").count() == 0
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PreprocessorModel.load(str(tmp_path / "p"))
    a = model.transform(df).toPandas()
    b = again.transform(df).toPandas()
    assert "y" not in a.columns and a.equals(b)


def test_iterative_imputer_recovers_linear_relation(spark):
    from tessera.operators.impute import impute_iterative
    rng = np.random.default_rng(9)
    x = rng.normal(size=400)
    y = 2 * x + 1 + 0.01 * rng.normal(size=400)
    miss = rng.random(400) < 0.3
    pdf = pd.DataFrame({"k": np.arange(400), "x": x, "y": np.where(miss, np.nan, y)}).replace({np.nan: None})
    out = impute_iterative(spark.createDataFrame(pdf), ["y"], features=["x", "y"]).toPandas().sort_values("k")
    err_model = np.abs(out["y"].to_numpy()[miss] - y[miss]).mean()
    err_mean = np.abs(np.nanmean(np.where(miss, np.nan, y)) - y[miss]).mean()
    assert err_model < 0.1 * err_mean
    assert np.allclose(out["y"].to_numpy()[~miss], y[~miss])


def test_latest_scaler_by_modification_time(spark, tmp_path):
    import time
    from tessera.operators.scale import Scaler, load_latest_scaler
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 3.0, 10.0]}))
    Scaler({"columns": ["a"], "method": "standard"}).fit(df).write().save(str(tmp_path / "s1"))
    time.sleep(1.1)
    Scaler({"columns": ["a"], "method": "minmax"}).fit(df).write().save(str(tmp_path / "s2"))
    latest = load_latest_scaler(spark, str(tmp_path))
    assert latest.conf["method"] == "minmax"


def test_large_training_tables_are_dealt_over_tasks(spark, monkeypatch):
    from tessera.operators import noise
    df = spark.range(0, 1000, 1, 2)
    assert noise._spread(df) is df
    monkeypatch.setattr(noise, "SPREAD", 100)
    monkeypatch.setattr(noise, "EACH", 10)
    got = noise._spread(df)
    assert got.rdd.getNumPartitions() == 100 and got.count() == 1000
    assert max(got.rdd.glom().map(len).collect()) <= 30
