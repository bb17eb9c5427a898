"""Sizes above the former limits: classes, categories, groups, columns,
partitions."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.functions.exprs import md5_unit
from tessera.operators import charts, encode, evaluate, train
from tessera.operators.split import class_thresholds, split
from tessera.plans import ranks
from tessera.plans import stats as S


# ------------------------------------------------------------ TRN1, classes
def test_stratified_split_of_many_classes(spark):
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 20_011).alias("y"))
    tr, te = split(df, "id", 0.25, stratify="y")
    got = {r["y"]: r["n"] for r in te.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r["y"]: math.ceil(0.25 * r["n"]) for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(want) > 10_000 and got == want
    assert tr.columns == df.columns and tr.count() + te.count() == n
    plan = tr._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_stratified_split_takes_the_smallest_hashes_and_null_is_a_class(spark):
    rows = [(i, [None, "a", "b"][i % 3]) for i in range(90)] + [(1000, "one")]
    df = spark.createDataFrame(rows, "k long, y string")
    _, te = split(df, "k", 0.3, stratify="y")
    got = {r["k"] for r in te.collect()}
    h = {r["k"]: r["h"] for r in df.select("k", md5_unit("k").alias("h")).collect()}
    for y in (None, "a", "b", "one"):
        ks = sorted((k for k, v in rows if v == y), key=lambda k: h[k])
        assert {k for k in ks if k in got} == set(ks[:math.ceil(0.3 * len(ks))])
    assert class_thresholds(df.select(F.col("y").alias("__y"), md5_unit("k").alias("__h")), 0.0).agg(F.max("__t")).first()[0] >= 0


# --------------------------------------------------------- EVL1, EVL3 - EVL5
def test_evaluation_of_fifty_thousand_classes(spark):
    n = 120_000
    pred = spark.range(n).select((F.col("id") % 50_000).alias("label"),
                                 F.when(F.col("id") % 4 == 0, (F.col("id") * 7 + 1) % 50_000)
                                 .otherwise(F.col("id") % 50_000).alias("prediction"))
    m = evaluate.classification_metrics(pred).collect()
    assert len(m) == 1
    p = pred.toPandas()
    tp = p[p.label == p.prediction].groupby("label").size()
    sup, pre = p.groupby("label").size(), p.groupby("prediction").size()
    pr = (tp.reindex(sup.index, fill_value=0) / pre.reindex(sup.index)).fillna(0)
    rc = tp.reindex(sup.index, fill_value=0) / sup
    f1 = (2 * pr * rc / (pr + rc)).fillna(0)
    assert math.isclose(m[0]["accuracy"], (p.label == p.prediction).mean())
    assert math.isclose(m[0]["precision"], (pr * sup).sum() / n) and math.isclose(m[0]["recall"], (rc * sup).sum() / n)
    assert math.isclose(m[0]["f1"], (f1 * sup).sum() / n)
    assert evaluate.classification_report(pred).count() == 50_003
    assert evaluate.class_counts(pred).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first() == (
        int(tp.sum()), n - int(tp.sum()), n - int(tp.sum()))
    pairs = evaluate.confusion_matrix(pred, zeros=False)
    assert pairs.agg(F.sum("count")).first()[0] == n


def test_empty_predictions(spark):
    none = spark.createDataFrame([], "label string, prediction string")
    assert tuple(evaluate.classification_metrics(none).first()) == (0.0, 0.0, 0.0, 0.0)
    assert evaluate.confusion_matrix(none).count() == 0
    assert [r["class"] for r in evaluate.classification_report(none).collect()] == ["accuracy", "macro avg", "weighted avg"]


# ----------------------------------------------- ENC3 - ENC6, ENC9, ENC11
def _codes(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"),
                                 (F.col("id") % 2).cast("double").alias("label"))


def test_one_hot_of_200_000_categories(spark, tmp_path):
    n = 200_000
    df = _codes(spark, n)
    model = encode.Encoder({"target": "label", "columns": {"c": "onehot"}}).fit(df)
    model.write().save(str(tmp_path / "m"))
    again = encode.EncoderModel.load(str(tmp_path / "m"))
    assert "tessera" not in str(again.fitted["c"]["table"]) and str(tmp_path) in again.fitted["c"]["table"]
    few = df.where("id in (0, 1, 77, 199999)").union(spark.createDataFrame([(-1, "unseen", 0.0), (-2, None, 1.0)], "id long, c string, label double"))
    for m in (model, again):
        got = {r["id"]: r["c_onehot"] for r in m.transform(few).collect()}
        assert all(v.size == n - 1 for v in got.values())
        assert {k: list(v.indices) for k, v in got.items()} == {0: [], 1: [0], 77: [76], 199999: [199998], -1: [], -2: []}


def test_one_hot_vector_equals_columns_and_trains(spark, monkeypatch):
    df = _codes(spark, 40).withColumn("c", F.concat(F.lit("k"), F.col("id") % 7)).withColumn("x", F.rand(3))
    wide = encode.encode(df, {"c": "onehot"})
    monkeypatch.setattr(encode, "ONEHOT_LIMIT", 3)
    vec = encode.Encoder({"columns": {"c": "onehot"}, "target": "label"}).fit(df).transform(df)
    a = wide.select([c for c in wide.columns if c.startswith("c_")]).toPandas().to_numpy()
    b = np.stack([v.toArray() for v in vec.toPandas()["c_onehot"]])
    assert np.array_equal(np.array(sorted(map(tuple, a))), np.array(sorted(map(tuple, b))))
    assert train.numeric_features(vec.drop("id"), "label") == ["x", "c_onehot"]
    data = train.assemble(vec, ["x", "c_onehot"])
    assert LogisticRegression(maxIter=5).fit(data).coefficients.size == 7
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x", "c_onehot"], outputCol="features"), LogisticRegression(maxIter=3)])
    assert pipe.fit(vec).transform(vec).count() == 40


@pytest.mark.parametrize("method", ["ordinal", "frequency", "binary"])
def test_code_tables_equal_maps(spark, monkeypatch, tmp_path, method):
    rows = [(i, f"v{i % 700:03d}" if i % 9 else None) for i in range(2100)]
    df = spark.createDataFrame(rows, "k long, c string")
    config = {"columns": {"c": method}, "order_key": "k"}
    held = spark.createDataFrame([(9999, "unseen"), (9998, None)], df.schema).unionByName(df)
    by_map = encode.Encoder(config).fit(df).transform(held).toPandas().sort_values("k")
    monkeypatch.setattr(encode, "MAP_LIMIT", 50)
    model = encode.Encoder(config).fit(df)
    assert "table" in model.fitted["c"]
    model.write().save(str(tmp_path / "m"))
    by_table = encode.EncoderModel.load(str(tmp_path / "m")).transform(held).toPandas().sort_values("k")
    assert by_map.reset_index(drop=True).equals(by_table.reset_index(drop=True))
    monkeypatch.setattr(encode, "LITERAL_LIMIT", 10_000)
    monkeypatch.setattr(encode, "MAP_LIMIT", 10_000)
    literal = encode.Encoder(config).fit(df).transform(held).toPandas().sort_values("k")
    assert by_map.reset_index(drop=True).equals(literal.reset_index(drop=True))


def test_train_only_and_target_codes_above_the_map(spark, monkeypatch):
    rows = [(f"v{i:03d}", float(i)) for i in range(300)] + [(None, 1.0)]
    tr = spark.createDataFrame(rows, "c string, x double")
    te = spark.createDataFrame([("v007", 1.0), ("new", 2.0), (None, 3.0)], tr.schema)
    want = [r["c"] for r in encode.encode_train_test(tr, te)[1].orderBy("x").collect()]
    enc_want, cats_want = encode.encode_target(tr, "c", "code")
    monkeypatch.setattr(encode, "MAP_LIMIT", 20)
    assert [r["c"] for r in encode.encode_train_test(tr, te)[1].orderBy("x").collect()] == want == [7, -1, -1]
    enc, cats = encode.encode_target(tr, "c", "code")
    assert cats == cats_want and sorted(map(str, enc.collect())) == sorted(map(str, enc_want.collect()))


def test_fitted_pipeline_takes_its_tables_along(spark, monkeypatch, tmp_path):
    from tessera.operators.prep import Preprocessor, PreprocessorModel
    monkeypatch.setattr(encode, "MAP_LIMIT", 30)
    df = spark.createDataFrame([(f"c{i % 90}", float(i), i % 2) for i in range(400)], "c string, x double, y int")
    model = Preprocessor({"target": "y", "encoding": {"c": "ordinal"}}).fit(df)
    want = model.transform(df).toPandas()
    Pipeline(stages=[model]).fit(df).write().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p")).stages[0]
    assert isinstance(again, PreprocessorModel) and str(tmp_path) in again.fitted["encoder"]["c"]["table"]
    assert np.allclose(np.sort(again.transform(df).toPandas().to_numpy(), 0), np.sort(want.to_numpy(), 0))


# ------------------------------------------------------------------- charts
def test_correlation_of_wide_table_with_nulls(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 60)) @ rng.normal(size=(60, 60)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 5.0
    x[:, 8] = np.nan
    x[:, 9] = np.where(np.isnan(x[:, 10]), x[:, 9], 3.0)          # constant wherever column 10 is present
    pdf = pd.DataFrame(x, columns=[f"a{i}" for i in range(60)])
    df = spark.createDataFrame(pdf.replace({np.nan: None}), ", ".join(f"a{i} double" for i in range(60)))
    monkeypatch.setattr(charts, "CORR_BLOCK", 25)
    got = charts.correlation_matrix(df).toPandas().pivot(index="col_a", columns="col_b", values="r")
    got = got.loc[pdf.columns, pdf.columns].to_numpy(float)
    want = pdf.corr().to_numpy()
    want[7, :] = want[:, 7] = np.nan
    want[9, 10] = want[10, 9] = np.nan
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(2)
    g = np.concatenate([np.full(4000, 0), rng.integers(1, 1500, 8000)])
    v = np.round(rng.normal(size=len(g)) * 10.0 ** rng.integers(-3, 4, len(g)), 2)
    v[:50] = 0.0
    v[50:60] = -0.0
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("g")["v"].quantile([0.1, 0.25, 0.5, 1.0]).unstack()
    for limit in (10 ** 9, 20, 0):         # all by percentile, hot groups by digits, all by digits
        got = S.grouped_quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 1.0], exact_distinct_limit=limit, max_groups=100)
        got = got.toPandas().set_index("g").loc[want.index]
        assert np.allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-9)


def test_sortable_bits_round_trip(spark):
    vals = [0.0, 1.5, -1.5, 1e308, -1e308, 5e-324, -5e-324, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", S._sortable("v").alias("b"))
    rows = df.select("v", "b", S._unsortable("b").alias("back")).collect()
    assert all(r["v"] == r["back"] for r in rows)
    assert [r["v"] for r in sorted(rows, key=lambda r: r["b"] & (1 << 64) - 1)] == sorted(vals)


# -------------------------------------------------------------- global ranks
def test_array_search_equals_nested_cases(spark, monkeypatch):
    rows = [(i, None if i % 11 == 0 else (i * 37) % 501, None if i % 13 == 0 else f"t{i % 29}") for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, v long, s string")
    for order in ([("v", True), ("s", False), ("k", True)], [("v", False), ("s", True), ("k", False)]):
        nested = ranks.global_row_number(df, order, out="r", partitions=40).toPandas().sort_values("k")["r"].tolist()
        monkeypatch.setattr(ranks, "NESTED_BOUNDS", 0)
        searched = ranks.global_row_number(df, order, out="r", partitions=40).toPandas().sort_values("k")["r"].tolist()
        monkeypatch.undo()
        assert nested == searched and sorted(nested) == list(range(6000))


def test_twenty_thousand_boundaries_plan_quickly(spark):
    df = spark.range(10).select("id", F.col("id").cast("string").alias("s"))
    bounds = [(i, str(i)) for i in range(20_000)]
    spec = [("id", True), ("s", True)]
    ranks._searched(df, spec, bounds).count()
    began = time.perf_counter()
    got = ranks._searched(df, spec, bounds)
    got._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5
    assert {r["id"]: r["__bkt"] for r in got.collect()} == {i: i for i in range(10)}
