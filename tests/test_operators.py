"""Operator unit tests on small hand-made tables (FIXTURES.md)."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import charts as V
from tessera.operators import clean as C
from tessera.operators import encode as E
from tessera.operators import evaluate as EV
from tessera.operators import impute as I
from tessera.operators import outliers as O
from tessera.operators import profile as P
from tessera.operators import scale as S
from tessera.operators import select as SEL
from tessera.sources import io as IO


def pdf(spark, frame):
    return spark.createDataFrame(pd.DataFrame(frame))


# ------------------------------------------------------------------ outliers
# Parcels: more than ten weights, exactly ten widths. Weights sorted are
# 10 .. 20 and 100: quartiles at places 2.75 and 8.25 are 12.75 and 18.25, so
# the fences are 12.75 - 8.25 = 4.5 and 18.25 + 8.25 = 26.5.
PARCELS = [  # parcel, weight, width, express, late
    (1, 14, 0.5, 0, 0), (2, 19, 1.0, 1, 0), (3, 11, 1.5, 0, 1), (4, 17, 2.0, 1, 0), (5, 20, 2.5, 0, 0), (6, 12, 3.0, 0, 1),
    (7, 16, 900.0, 1, 1), (8, 10, 3.5, 1, 0), (9, 18, 4.0, 0, 0), (10, 13, 4.5, 0, 1), (11, 100, 0.5, 1, 1), (12, 15, 1.0, 0, 0)]


def parcels(spark):
    return spark.createDataFrame(PARCELS, "parcel long, weight long, width double, express int, late int")


def test_ten_distinct_values_are_low_cardinality_and_stay(spark):
    ft = O.classify_features(parcels(spark), target=["late", "parcel"])
    assert (ft.binary, ft.low_cardinality, ft.continuous) == (["express"], ["width"], ["weight"])
    capped = O.cap_outliers(parcels(spark), target=["late", "parcel"]).orderBy("parcel").toPandas()
    assert capped["width"].tolist() == [r[2] for r in PARCELS]


def test_eleven_distinct_values_are_capped_at_the_fences(spark):
    df = parcels(spark)
    got = O.cap_outliers(df, target=["late", "parcel"], keep_int=True).orderBy("parcel").toPandas()
    assert got["weight"].tolist() == [14, 19, 11, 17, 20, 12, 16, 10, 18, 13, 26, 15]      # 26.5 goes to the even 26
    assert str(got["weight"].dtype).startswith("int")
    details = O.outlier_details(df, keys="parcel", exclude=["late", "parcel"]).toPandas()
    assert details[["parcel", "column_name"]].values.tolist() == [[11, "weight"]]
    copy = O.cap_outliers(df, target=["late", "parcel"], keep_int=False)
    assert dict(copy.dtypes)["weight"] == "double"
    assert copy.agg({"weight": "max"}).first()[0] == 26.5


def test_iqr_zero_is_skipped(spark):
    df = pdf(spark, {"x": [5.0] * 20 + [float(i) for i in range(11)]})
    plan = O.iqr_plan(df)
    assert "x" not in plan.bounds or plan.bounds["x"][0] < plan.bounds["x"][1]


# ----------------------------------------------------------------- profiling
def test_missing_tiers_and_mode_ties(spark):
    n = 100
    rng = np.random.default_rng(0)
    a = rng.normal(size=n)
    a[:5] = np.nan
    b = rng.normal(size=n)
    b[:40] = np.nan
    c = rng.normal(size=n)
    c[:60] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": range(n), "a": a, "b": b, "c": c}).replace({np.nan: None}))
    rec = I.recommend_imputation(df)
    assert rec == {"c": "iterative", "b": "knn", "a": "mean"}
    ties = spark.createDataFrame([("x", 1), ("y", 2), ("x", 2), ("y", 1), (None, None)], "s string, n int")
    fills = C.default_fills(ties)
    assert fills["s"] == "x" and math.isclose(fills["n"], 1.5)
    assert I.imputation_fills(ties, {"s": "most_frequent", "n": "most_frequent"})["fills"] == {"s": "x", "n": 1}


def test_all_null_text_column_gets_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, s string")
    out = C.fill_default(df).toPandas()
    assert out["s"].tolist() == ["Unknown", "Unknown"]
    assert IO.drop_empty_columns(df).columns == ["k"]


def test_empty_and_narrow_tables_rejected(spark):
    with pytest.raises(ValueError):
        IO.validate_table(spark.createDataFrame([], "a int, b int"))
    with pytest.raises(ValueError):
        IO.validate_table(spark.createDataFrame([(1,)], "a int"))


def test_unique_and_normalized_names(spark):
    assert IO.unique_column_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    with pytest.raises(ValueError):
        C.normalize_columns(df)


def test_skewness_matches_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 50.0]
    df = pdf(spark, {"x": vals})
    rows = P.missing_profile_rows(df, only_missing=False)
    assert math.isclose(rows[0]["skewness"], round(pd.Series(vals).skew(), 3))


# ------------------------------------------------------------------- scaling
SCALING = {
    "depth": [3.5, 9.25, 4.0, 12.75, 7.5, 0.5, 6.25],
    "salinity": [31, 35, 35, 28, 40, 33, 37],
    "turbidity": [6, 6, 6, 6, 6, 6, 6],
    "station": ["n", "n", "w", "e", "w", "s", "e"],
}


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling_demo(spark, method):
    df = pdf(spark, SCALING)
    out = S.scale(df, ["depth", "salinity", "turbidity"], method).toPandas()
    for c in ["depth", "salinity", "turbidity"]:
        x = pd.Series(SCALING[c], dtype=float)
        if method == "standard":
            sd = x.std(ddof=0) or 1.0
            exp = (x - x.mean()) / sd
        elif method == "minmax":
            rng = (x.max() - x.min()) or 1.0
            exp = (x - x.min()) / rng
        else:
            iqr = (x.quantile(0.75) - x.quantile(0.25)) or 1.0
            exp = (x - x.median()) / iqr
        assert np.allclose(out[c].to_numpy(), exp.to_numpy())
    assert out["station"].tolist() == SCALING["station"]


def test_scaler_save_load(spark, tmp_path):
    df = pdf(spark, SCALING)
    m = S.Scaler({"columns": ["depth"], "method": "robust"}).fit(df)
    m.write().overwrite().save(str(tmp_path / "s"))
    m2 = S.ScalerModel.load(str(tmp_path / "s"))
    a = m.transform(df).toPandas()
    b = m2.transform(df).toPandas()
    assert a.equals(b)


# ------------------------------------------------------------ correlation
def test_constant_column_correlation_is_null(spark):
    df = pdf(spark, {"row_id": [1, 2, 3, 4], "x": [2.0, 2.0, 2.0, 2.0], "y": [1.0, 3.0, 2.0, 5.0]})
    out, removed = SEL.correlation_importance(df, "y", ["x", "row_id"])
    assert out.count() == 0 and removed == ["row_id"]
    irr = {r["feature"]: r["reason"] for r in SEL.irrelevant_features(df.drop("row_id"), "y").collect()}
    assert irr == {"x": "constant"}


def test_identifier_rule():
    assert SEL.is_identifier("loan_id") and SEL.is_identifier("ID_card") and SEL.is_identifier("serial_no")
    assert not SEL.is_identifier("income")


def test_anova_matches_numpy(spark):
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1, 2], 30)
    x = rng.normal(size=90) + y
    df = pdf(spark, {"x": x, "y": y})
    f = SEL.anova_f(df, "y", ["x"])["x"]
    groups = [x[y == g] for g in range(3)]
    grand = x.mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert math.isclose(f, (ssb / 2) / (ssw / 87), rel_tol=1e-9)


# ------------------------------------------------------------------ encoding
def test_encoding_advice_boundaries(spark):
    n = 60
    cols = {"k": list(range(n)), "target": [i % 2 for i in range(n)]}
    for d in (1, 2, 3, 10, 11, 50, 51):
        cols[f"c{d}"] = [f"v{i % d:02d}" for i in range(n)]
    cols["lvl"] = [["low", "medium", "high"][i % 3] for i in range(n)]
    df = pdf(spark, cols)
    rec = {r["column_name"]: r["recommended"] for r in E.encoding_advice_rows(df, "target", samples=0)}
    assert rec["c2"] == "label" and rec["c3"] == "onehot" and rec["c10"] == "onehot"
    assert rec["c11"] == "ordinal" and rec["c50"] == "ordinal" and rec["c51"] == "frequency"
    assert rec["lvl"] == "ordinal" and rec["k"] == "none" and rec["target"] == "none"


def test_unseen_and_null_categories(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b")], "k int, s string")
    test = spark.createDataFrame([(5, "c"), (6, None), (7, "a")], "k int, s string")
    for method, check in [
        ("ordinal", lambda r: r == {5: -1, 6: 0, 7: 1}),          # 'None' sorts before 'a' (byte order)
        ("frequency", lambda r: r == {5: 0.0, 6: 0.0, 7: 1 / 3}),
    ]:
        m = E.Encoder({"columns": {"s": method}}).fit(train)
        got = {r["k"]: r["s"] for r in m.transform(test).collect()}
        assert check(got), (method, got)
    m = E.Encoder({"columns": {"s": "binary"}, "order_key": "k"}).fit(train)
    got = {r["k"]: (r["s_bit0"], r["s_bit1"]) for r in m.transform(test).collect()}
    assert got[5] == (1, 1) and got[6] == (1, 1) and got[7] == (0, 0)
    m = E.Encoder({"columns": {"s": "onehot"}}).fit(train)
    out = m.transform(test)
    assert out.columns == ["k", "s_a", "s_b"]                  # first category ('None') dropped
    got = {r["k"]: (r["s_a"], r["s_b"]) for r in out.collect()}
    assert got[5] == (0.0, 0.0) and got[6] == (0.0, 0.0) and got[7] == (1.0, 0.0)
    tr, te = E.encode_train_test(train, test)
    assert {r["k"]: r["s"] for r in te.collect()} == {5: -1.0, 6: -1.0, 7: 0.0} or \
        {r["k"]: r["s"] for r in te.collect()} == {5: -1, 6: -1, 7: 0}


def test_large_cardinality_uses_code_table(spark, monkeypatch):
    monkeypatch.setattr(E, "MAP_LIMIT", 5)
    df = spark.range(0, 40).selectExpr("id", "concat('v', lpad(CAST(id % 20 AS STRING), 2, '0')) AS s")
    m = E.Encoder({"columns": {"s": "ordinal"}}).fit(df)
    assert "table" in m.fitted["s"]
    got = {r["id"]: r["s"] for r in m.transform(df).collect()}
    assert all(got[i] == i % 20 for i in range(40))


# ---------------------------------------------------------------- evaluation
def test_classification_metrics_by_hand(spark):
    y = ["a", "a", "b", "b", "c", "c", "c", "a"]
    p = ["a", "b", "b", "b", "c", "a", "c", "c"]
    df = spark.createDataFrame(list(zip(y, p)), "label string, prediction string")
    m = EV.classification_metrics(df).first()
    classes = sorted(set(y) | set(p))
    prec, rec, sup = [], [], []
    for c in classes:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        pc = sum(1 for b in p if b == c)
        tc = sum(1 for a in y if a == c)
        prec.append(tp / pc if pc else 0)
        rec.append(tp / tc if tc else 0)
        sup.append(tc)
    f1 = [2 * a * b / (a + b) if a + b else 0 for a, b in zip(prec, rec)]
    w = lambda v: sum(a * s for a, s in zip(v, sup)) / len(y)
    assert math.isclose(m["accuracy"], 5 / 8)
    assert math.isclose(m["precision"], w(prec)) and math.isclose(m["recall"], w(rec))
    assert math.isclose(m["f1"], w(f1))
    cm = EV.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 8


def test_roc_auc_with_ties_matches_rank_formula(spark):
    y = [0, 0, 1, 1, 0, 1, 1, 0, 1, 0]
    s = [0.1, 0.4, 0.4, 0.8, 0.4, 0.9, 0.2, 0.2, 0.7, 0.1]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    ranks = pd.Series(s).rank()
    npos, nneg = sum(y), len(y) - sum(y)
    u = ranks[[i for i, v in enumerate(y) if v == 1]].sum() - npos * (npos + 1) / 2
    assert math.isclose(EV.roc_auc(df), u / (npos * nneg))
    one_class = spark.createDataFrame([(1, 0.3), (1, 0.5)], "label int, score double")
    assert EV.roc_auc(one_class) == 0.0


def test_regression_metrics(spark):
    y = [3.0, -0.5, 2.0, 7.0, 0.0]
    p = [2.5, 0.0, 2.0, 8.0, 0.05]
    df = spark.createDataFrame(list(zip(y, p)), "y double, pred double")
    m = EV.regression_metrics(df).first()
    yy, pp = np.array(y), np.array(p)
    assert math.isclose(m["mae"], np.abs(yy - pp).mean())
    assert math.isclose(m["rmse"], math.sqrt(((yy - pp) ** 2).mean()))
    assert math.isclose(m["r2"], 1 - ((yy - pp) ** 2).sum() / ((yy - yy.mean()) ** 2).sum())
    acc = EV.tolerance_accuracy(df).first()[0]
    assert math.isclose(acc, 40.0)   # 2.0 exact and 0 -> |0.05| <= 0.1; the other three miss


# --------------------------------------------------------------------- charts
DASHBOARD = {
    "basin": ["north", "south", "south", "east", "north", "south", "east", "south", "north"],
    "rain": [12, 55, 31, 8, 27, 60, 19, 44, 35],
    "runoff": [3.0, 21.5, 9.0, 1.5, 8.0, 30.0, 4.5, 15.0, 11.0],
}


def test_dashboard_charts(spark):
    df = pdf(spark, DASHBOARD)
    h = V.histogram(df, "rain", bins=4).orderBy("bin").toPandas()
    assert h["count"].tolist() == [3, 2, 2, 2]  # edges 8, 21, 34, 47, 60
    box = {r["basin"]: r for r in V.box_stats(df, "runoff", by="basin").collect()}
    assert math.isclose(box["south"]["median"], (15.0 + 21.5) / 2) and math.isclose(box["east"]["median"], 3.0)
    pie = V.category_counts(df, "basin").collect()
    assert [(r["value"], r["count"]) for r in pie] == [("south", 4), ("north", 3), ("east", 2)]
    pts = V.pair_points(df, ["rain", "runoff"], hue="basin", max_points=None)
    assert pts.count() == 9
    corr = {(r["col_a"], r["col_b"]): r["r"] for r in V.correlation_matrix(df, ["rain", "runoff"]).collect()}
    assert math.isclose(corr[("rain", "runoff")], np.corrcoef(DASHBOARD["rain"], DASHBOARD["runoff"])[0, 1])


def test_json_lines_and_arrays(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}, {"a": 3, "b": "y"}]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays" / "1.json").write_text(json.dumps(rows[:2], indent=1))
    (tmp_path / "arrays" / "2.json").write_text("  " + json.dumps(rows[2:]))
    for name in ("lines.json", "arrays"):
        got = IO.read_table(spark, str(tmp_path / name), "json")
        assert sorted(map(tuple, got.select("a", "b").collect())) == [(1, "x"), (2, None), (3, "y")]


def test_edits_of_one_key_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b")], "k int, v double, s string")
    edits = spark.createDataFrame([(1, 9.0, "z"), (1, 7.0, "y"), (1, 8.0, None)], "k int, v double, s string")
    for e in (edits, edits.orderBy("v"), edits.orderBy(edits.v.desc())):
        assert sorted(map(tuple, O.apply_edits(df, e, "k").collect())) == [(1, 7.0, "y"), (2, 6.0, "b")]


def test_clean_counts_copies_and_fills_from_them(spark):
    rows = [("x", 1.0), ("x", 1.0), ("x", None), ("y", 4.0), (None, 4.0), (None, 4.0), ("x", 2.0)]
    out, rep = C.clean(spark.createDataFrame(rows, "`S t` string, v double"))
    want = {("x", 1.0), ("x", 16 / 6), ("y", 4.0), ("x", 4.0), ("x", 2.0)}
    assert {tuple(r) for r in out.collect()} == want and out.columns == ["s_t", "v"]
    assert tuple(rep.first()) == (7, 2, 3, 3, 5, 2)


def test_roc_auc_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    s = rng.normal(size=300) + y
    df = spark.createDataFrame(pd.DataFrame({"label": y.astype(float), "score": s}))
    ours = EV.roc_auc(df)
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(df)
    assert math.isclose(ours, theirs, abs_tol=1e-9)


def test_box_stats_without_groups(spark):
    df = pdf(spark, DASHBOARD)
    r = V.box_stats(df, "runoff").first()
    s = pd.Series(DASHBOARD["runoff"], dtype=float)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    inside = s[(s >= q1 - 1.5 * (q3 - q1)) & (s <= q3 + 1.5 * (q3 - q1))]
    assert (r["n"], r["q1"], r["median"], r["q3"]) == (9, q1, s.median(), q3)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (inside.min(), inside.max(), 9 - len(inside))


def test_wide_correlation_gramian_matches_aggregate(spark):
    rng = np.random.default_rng(8)
    data = {f"x{i}": rng.normal(size=200) for i in range(24)}
    data["x23"] = np.full(200, 3.0)                      # zero variance -> NULL
    df = spark.createDataFrame(pd.DataFrame(data))
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in V.correlation_matrix(df).collect()}
    narrow = {(r["col_a"], r["col_b"]): r["r"] for r in V.correlation_matrix(df, ["x0", "x1", "x23"]).collect()}
    assert wide[("x23", "x0")] is None and narrow[("x23", "x0")] is None
    assert math.isclose(wide[("x0", "x1")], narrow[("x0", "x1")], rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(wide[("x0", "x1")], np.corrcoef(data["x0"], data["x1"])[0, 1], rel_tol=1e-9)


def test_reviewed_decimal_text_reaches_an_integer_target(spark):
    from tessera.operators import noise
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, y int")
    review = spark.createDataFrame([(1, "123.45"), (2, "7.0"), (3, "x")], "k int, predicted_target string")
    out, changed = noise.apply_labels(df, review, "k", "y")
    assert changed == 2 and {r["k"]: r["y"] for r in out.collect()} == {1: 123, 2: 7, 3: 7}
