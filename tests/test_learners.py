"""Own learners: softmax boosting, kernel machines, forests without a depth
limit; each against a direct computation, and saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.operators import boosting, forest, kernel


def _data(spark, x, y, parts=4):
    rows = [(i, *map(float, r), None if v is None else float(v)) for i, (r, v) in enumerate(zip(x, y))]
    names = [f"f{i}" for i in range(np.shape(x)[1])]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names) + ", label double").repartition(parts, "k")
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df), names


def _scored(model, df, *cols):
    return model.transform(df).select("k", *cols).toPandas().sort_values("k")


# ------------------------------------------------------------------ boosting
def _direct_boosting(x, y, classes, rounds, depth, rate):
    """The same rounds on one machine, with all values as cuts."""
    n = len(x)
    s = np.tile(np.log(np.bincount(y, minlength=classes) / n), (n, 1))
    for _ in range(rounds):
        e = np.exp(s - s.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        for k in range(classes):
            r = (y == k) - p[:, k]
            nodes = [np.arange(n)]
            for _ in range(depth):
                following = []
                for rows in nodes:
                    best = (1e-12 * max(1, len(rows)), None)
                    for f in range(x.shape[1]):
                        for v in np.unique(x[rows, f])[:-1]:
                            left = rows[x[rows, f] <= v]
                            right = rows[x[rows, f] > v]
                            gain = (r[left].mean() - r[right].mean()) ** 2 * len(left) * len(right) / len(rows)
                            if gain > best[0] * (1 + 1e-12):
                                best = (gain, (left, right))
                    following += [rows] if best[1] is None or len(rows) < 2 else list(best[1])
                nodes = following
            for rows in nodes:
                h = (np.abs(r[rows]) * (1 - np.abs(r[rows]))).sum()
                s[rows, k] += rate * (classes - 1) / classes * r[rows].sum() / h
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_boosting_equals_direct_computation(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, size=(120, 3)).astype(float) + rng.random((1, 3))
    y = ((x[:, 0] > 6).astype(int) + (x[:, 1] > 8)).astype(int)
    y[:9] = rng.integers(0, 3, 9)
    df, names = _data(spark, x, y)
    model = boosting.SoftmaxBoosting({"classes": 3, "rounds": 7}).fit(df)
    got = np.stack(_scored(model, df, "probability")["probability"].map(lambda v: v.toArray()))
    assert np.allclose(got, _direct_boosting(x, y, 3, 7, 3, 0.1), atol=1e-9)
    assert model.featureImportances.toArray()[:2].sum() > 0.8


def test_boosting_of_two_classes_and_of_numbers(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, size=(100, 2)).astype(float)
    y = ((x[:, 0] > 4) ^ (rng.random(100) < 0.1)).astype(int)
    df, _ = _data(spark, x, y)
    got = _scored(boosting.SoftmaxBoosting({"classes": 2, "rounds": 4}).fit(df), df, "probability")
    p = np.stack(got["probability"].map(lambda v: v.toArray()))
    assert np.allclose(p, _direct_boosting(x, y, 2, 4, 3, 0.1), atol=1e-9)
    # squares: 40 rounds of depth 3 on the residuals, each a tenth of the leaf means
    t = 3 * x[:, 0] - x[:, 1] ** 2
    df, _ = _data(spark, x, t)
    model = boosting.SquareBoosting({"rounds": 25}).fit(df)
    r = _scored(model, df, "prediction")["prediction"].to_numpy() - t
    assert (r ** 2).mean() < 0.1 * t.var() and abs(r.mean()) < 1e-9
    one = boosting.SquareBoosting({"rounds": 1, "depth": 1, "rate": 1.0}).fit(df)
    p = _scored(one, df, "prediction")["prediction"].to_numpy()
    best = min((((t[x[:, f] <= v] - t[x[:, f] <= v].mean()) ** 2).sum() + ((t[x[:, f] > v] - t[x[:, f] > v].mean()) ** 2).sum())
               for f in range(2) for v in np.unique(x[:, f])[:-1])
    assert abs(((p - t) ** 2).sum() - best) < 1e-6


def test_boosting_over_passes_of_classes_and_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 2)), rng.integers(0, 4, 300)
    x[rng.random(x.shape) < 0.1] = np.nan
    df, _ = _data(spark, x, y)
    one = _scored(boosting.SoftmaxBoosting({"classes": 4, "rounds": 3}).fit(df), df, "prediction")
    monkeypatch.setattr(boosting, "TABLE_MB", 0)
    from tessera.plans import passes
    monkeypatch.setattr(passes, "DIRECT", 1)
    two = _scored(boosting.SoftmaxBoosting({"classes": 4, "rounds": 3}).fit(df), df, "prediction")
    assert one["prediction"].tolist() == two["prediction"].tolist()


# -------------------------------------------------------------------- kernel
def _gap(z, y, w, c, eps):
    """Relative duality gap of 1/2|w|^2 + C sum loss, from the dual point the
    losses' slopes give; rows on a corner take what closes the equations."""
    wt, f = w[:-1], z @ w
    if eps is None:
        a, slope = 1 - y * f, y
        primal = 0.5 * wt @ wt + c * np.maximum(a, 0).sum()
    else:
        r = f - y
        a, slope = np.abs(r) - eps, -np.sign(r)
        primal = 0.5 * wt @ wt + c * np.maximum(a, 0).sum()
    return primal


def _best_primal(z, y, c, eps, steps=60000):
    """Averaged projected subgradient with a long run, from several starts: an upper bound of the optimum."""
    best, w = np.inf, np.zeros(z.shape[1])
    for t in range(steps):
        f = z @ w
        if eps is None:
            g = -(z * (y * (1 - y * f > 0))[:, None]).sum(0)
            loss = np.maximum(1 - y * f, 0).sum()
        else:
            r = f - y
            g = (z * (np.sign(r) * (np.abs(r) > eps))[:, None]).sum(0)
            loss = np.maximum(np.abs(r) - eps, 0).sum()
        best = min(best, 0.5 * w[:-1] @ w[:-1] + c * loss)
        g = c * g
        g[:-1] += w[:-1]
        w = w - 0.02 / np.sqrt(t + 1) * g / max(1.0, np.linalg.norm(g) / 10)
    return best


def test_svr_adds_up_the_next_gradients_in_the_same_pass(spark, monkeypatch):
    """With one problem a width that takes one whole step is one pass, and the
    weights are those of separate passes."""
    r = np.random.default_rng(4)
    rows = [(float(i), float(r.normal()), float(r.normal())) for i in r.uniform(-2, 2, 300)]
    df = spark.createDataFrame(rows, "a double, b double, e double").selectExpr("array(a, b) x", "2 * a - b + e y", "0 fold").repartition(3).persist()
    conf = {"mean": [0.0, 0.0], "gamma": 0.5, "dim": 12, "seed": 1}
    passes, summed, line = [], kernel.summed, kernel._line
    monkeypatch.setattr(kernel, "summed", lambda *a: passes.append(a[2]) or summed(*a))
    w = kernel.solve(df, conf, [(0.0, -1)], len(rows), 1.0, 0.1, 4.0)
    merged = list(passes)

    def apart(*a):
        make, size = line(*a[:6])
        more = kernel._derivatives(a[0], a[1] + a[2], a[3], a[4], a[6]) if a[6] else None
        if more is None:
            return make, size
        return (lambda b: (lambda b: np.concatenate([make(b), more[0](b)]))(list(b))), size + more[1]

    own = 13 + 13 * 13 + 1  # sums of a pass for gradients only
    assert merged.count(own) < len(merged) / 2
    monkeypatch.setattr(kernel, "_line", apart)
    assert np.allclose(kernel.solve(df, conf, [(0.0, -1)], len(rows), 1.0, 0.1, 4.0), w, rtol=1e-12)
    df.unpersist()


def test_svr_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + 0.2 * rng.normal(size=80)
    df, _ = _data(spark, x, y)
    model = kernel.RbfSvr({"dim": 32}).fit(df)
    s = model.fitted
    z = kernel._features(x, s)
    mine = _gap(z, y, np.array(s["w"]), 1.0, 0.1)
    assert mine <= 1.01 * _best_primal(z, y, 1.0, 0.1)
    got = _scored(model, df, "prediction")["prediction"].to_numpy()
    assert np.allclose(got, z @ np.array(s["w"]))


def test_svc_reaches_the_optimum_and_gives_probabilities(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 + 0.3 * rng.normal(size=200) > 1.2).astype(int)
    df, _ = _data(spark, x, y)
    model = kernel.RbfSvc({"classes": 2, "dim": 32}).fit(df)
    s = model.fitted
    z, w = kernel._features(x, s), np.array(s["w"])[:, 0]
    assert _gap(z, 2.0 * y - 1, w, 1.0, None) <= 1.01 * _best_primal(z, 2.0 * y - 1, 1.0, None)
    got = _scored(model, df, "probability", "prediction")
    p = np.stack(got["probability"].map(lambda v: v.toArray()))
    assert np.allclose(p.sum(1), 1) and (got["prediction"].to_numpy() == y).mean() > 0.88
    # calibrated: the mean of the probabilities is near the share of the class, and they rise with the class
    assert abs(p[:, 1].mean() - y.mean()) < 0.05 and p[y == 1, 1].mean() > p[y == 0, 1].mean() + 0.4


def test_svc_of_several_classes(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [3, 0], [0, 3], [3, 3]])
    y = rng.integers(0, 4, 240)
    x = centres[y] + 0.6 * rng.normal(size=(240, 2))
    df, _ = _data(spark, x, y)
    got = _scored(kernel.RbfSvc({"classes": 4, "dim": 64}).fit(df), df, "probability", "prediction")
    p = np.stack(got["probability"].map(lambda v: v.toArray()))
    assert p.shape == (240, 4) and np.allclose(p.sum(1), 1) and (got["prediction"].to_numpy() == y).mean() > 0.95


# -------------------------------------------------------------------- forest
@pytest.mark.parametrize("local_rows", [10_000, 40])
@pytest.mark.parametrize("classes", [0, 5])
def test_tree_fits_distinct_rows_exactly(spark, classes, local_rows):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = rng.integers(0, 5, 500) if classes else rng.normal(size=500)
    df, _ = _data(spark, x, y)
    model = forest.Forest({"classes": classes, "trees": 1, "bootstrap": False, "local_rows": local_rows}).fit(df)
    assert np.allclose(_scored(model, df, "prediction")["prediction"], y, rtol=1e-12)
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


@pytest.mark.parametrize("local_rows", [10_000, 30])
def test_deeper_than_thirty_levels(spark, local_rows):
    x = np.arange(80.0)[:, None]
    y = 3.0 ** np.arange(80)              # every split takes the largest row off
    df, _ = _data(spark, x, y)
    model = forest.Forest({"trees": 1, "bootstrap": False, "local_rows": local_rows}).fit(df)
    assert np.allclose(_scored(model, df, "prediction")["prediction"], y, rtol=1e-12)
    assert model.depth > 30


def test_many_equal_rows_and_values_between_edges(spark, monkeypatch):
    """Nodes above local_rows that no edge of the whole table parts: a third
    of the rows is equal, another third lies in one bin."""
    monkeypatch.setattr(forest, "BINS", 4)
    x = np.concatenate([np.full(300, 5.0), 10 + np.arange(300) * 1e-6, np.arange(300) * 10.0])[:, None]
    y = np.concatenate([np.arange(300) % 2, np.arange(300) % 3, np.arange(300) % 2])
    df, _ = _data(spark, x, y)
    model = forest.Forest({"classes": 3, "trees": 1, "bootstrap": False, "local_rows": 20}).fit(df)
    got = _scored(model, df, "prediction", "probability")
    assert (got["prediction"].to_numpy()[300:600] == y[300:600]).all()
    assert np.allclose(np.stack(got["probability"].map(lambda v: v.toArray()))[:300], [0.5, 0.5, 0.0], atol=0.01)


def test_equal_rows_of_several_classes_give_shares(spark):
    df, _ = _data(spark, [[1.0], [1.0], [1.0], [1.0], [2.0], [np.nan]], [0, 1, 1, 1, 0, 0])
    model = forest.Forest({"classes": 2, "trees": 1, "bootstrap": False}).fit(df)
    got = np.stack(_scored(model, df, "probability")["probability"].map(lambda v: v.toArray()))
    assert np.allclose(got, [[0.25, 0.75]] * 4 + [[1, 0]] * 2)


def test_forest_is_the_same_in_any_partitioning_and_after_loading(spark, tmp_path):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(400, 4)), rng.integers(0, 3, 400)
    raw, names = _data(spark, x, y)
    raw = raw.drop("features")
    stages = [VectorAssembler(inputCols=names, outputCol="features"),
              forest.Forest({"classes": 3, "trees": 12, "most": "sqrt", "local_rows": 90})]
    model = Pipeline(stages=stages).fit(raw)
    a = model.transform(raw).orderBy("k").select("prediction").toPandas()["prediction"].tolist()
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    b = again.transform(raw.repartition(7)).orderBy("k").select("prediction").toPandas()["prediction"].tolist()
    assert a == b and np.mean(np.array(a) == y) > 0.9
    assert np.allclose(again.stages[-1].featureImportances.toArray(), model.stages[-1].featureImportances.toArray())


@pytest.mark.parametrize("classes", [0, 3])
def test_large_forest_is_scored_where_its_subtrees_are(spark, tmp_path, monkeypatch, classes):
    """Never whole in one task or on the driver, and the same answers."""
    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = rng.integers(0, classes, 300) if classes else rng.normal(size=300)
    df, _ = _data(spark, x, y)
    model = forest.Forest({"classes": classes, "trees": 7, "local_rows": 50, "most": "sqrt" if classes else "all"}).fit(df)
    names = ["prediction", "probability"][:2 if classes else 1]
    small = _scored(model, df, *names)
    model.write().overwrite().save(str(tmp_path / "m"))
    monkeypatch.setattr(forest, "MODEL_MB", 0)
    monkeypatch.setattr(forest, "MEET", 20)
    monkeypatch.setattr(forest, "_assemble", None)
    for m in (model, forest.ForestModel.load(str(tmp_path / "m"))):
        m._sent = None
        large = _scored(m, df.repartition(5), *names)
        assert small.astype(str).to_numpy().tolist() == large.astype(str).to_numpy().tolist()


def test_weights_are_poisson_and_differ_by_tree():
    w = [forest._weights(np.arange(20000), t, 42, True) for t in range(3)]
    assert all(abs(v.mean() - 1) < 0.03 and abs(v.var() - 1) < 0.06 for v in w)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03


def test_boosting_and_kernel_models_load(spark, tmp_path):
    rng = np.random.default_rng(9)
    raw, names = _data(spark, rng.normal(size=(90, 2)), rng.integers(0, 3, 90))
    raw = raw.drop("features")
    for i, est in enumerate([boosting.SoftmaxBoosting({"classes": 3, "rounds": 2}), kernel.RbfSvc({"classes": 3, "dim": 8}),
                             kernel.RbfSvr({"dim": 8})]):
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), est]).fit(raw)
        model.write().overwrite().save(str(tmp_path / f"m{i}"))
        again = PipelineModel.load(str(tmp_path / f"m{i}"))
        p, q = (m.transform(raw).select("k", F.round("prediction", 9)).orderBy("k").collect() for m in (model, again))
        assert p == q


def test_comparison_with_a_target_named_label(spark):
    from tessera.operators import train
    rng = np.random.default_rng(12)
    y = rng.integers(0, 3, 150)
    x = np.stack([y + 0.3 * rng.normal(size=150), rng.normal(size=150)], 1)
    rows = [(i, float(a), float(b), f"c{v}") for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, a double, b double, label string")
    tr, te = df.where("k % 4 > 0"), df.where("k % 4 = 0")
    res, best, fitted = train.train_classification(tr, te, "label", ["a", "b"], ["naive_bayes", "decision_tree", "random_forest"])
    got = {r["model"]: r for r in res.collect()}
    assert list(fitted) == ["naive_bayes", "decision_tree", "random_forest"] and best in got
    assert all(r["accuracy"] > 0.8 and r["roc_auc"] > 0.85 for r in got.values())


def _counted(spark, df):
    """``df`` behind a shuffle, and how many rows were made of it so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.repartition(2).mapInArrow(count, df.schema), seen


def test_a_comparison_reads_its_test_rows_once(spark):
    from tessera.operators import train
    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 + F.col("id") % 7 * 2).cast("double").alias("y"))
    te, seen = _counted(spark, df.where("a < 3"))
    n = df.where("a < 3").count()
    res, _best, _fitted = train.train_regression(df, te, "y", ["a"], ["linear_regression"] * 2)
    assert res.count() == 2 and seen.value == n
    te, seen = _counted(spark, df.where("a < 3").withColumn("y", F.col("y") % 2))
    train.train_classification(df.withColumn("y", F.col("y") % 2), te, "y", ["a"], ["logistic_regression", "naive_bayes"])
    assert seen.value == n


def test_regression_noise_scores_each_row_once(spark):
    """The joins before it run once and the review reads staged scores."""
    from tessera.operators import noise
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11 + F.col("id") % 7 * 9).cast("double").alias("y"))
    rows, seen = _counted(spark, df)
    review, report = noise.detect_label_noise_regression(rows, "y", keys="id", n_trees=5)
    made = seen.value
    assert made == 300
    assert 0 < review.count() <= 30 and seen.value == made


def test_a_failed_auc_is_no_result(spark, monkeypatch):
    """An error in the ROC-AUC ends the comparison; one class among the test
    rows leaves it without a value."""
    from tessera.operators import evaluate, train
    rows = [(k, float(k % 10 + 3 * (k % c)), str(k % c), c) for c in (2, 3) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, y string, c int")
    for c, name in ((2, "roc_auc"), (3, "roc_auc_ovr")):
        part = df.where(F.col("c") == c)
        res, _best, _fitted = train.train_classification(part, part.where("y = '1'"), "y", ["a"], ["naive_bayes"])
        assert res.first()["roc_auc"] is None
        assert train.train_classification(part, part, "y", ["a"], ["naive_bayes"])[0].first()["roc_auc"] > 0.5

        def broken(*args, **kwargs):
            raise RuntimeError("broken")

        monkeypatch.setattr(evaluate, name, broken)
        with pytest.raises(RuntimeError, match="broken"):
            train.train_classification(part, part, "y", ["a"], ["naive_bayes"])


def test_mixed_automl_gives_the_saved_winners_predictions(spark, tmp_path, monkeypatch):
    """One row per model, then one per test row, scored by the model read
    back: their share of hits is the winner's accuracy."""
    from tessera.catalog import QUERIES
    from tessera.operators import automl
    from tessera.operators.split import split
    monkeypatch.setattr(automl, "recommend_models", lambda profile: [("logistic_regression", 1)])
    docs = [(k, ["en", "de", "fr"][k % 3], f"src{k % 4}", 100 + k * 37 % 211) for k in range(240)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k * 37 % 211 > 90 + k % 50), k % 2) for k in range(0, 240, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["aml1_automl_mixed"](spark, str(tmp_path)).collect()
    results, told = [r for r in rows if r["doc_id"] is None], [r for r in rows if r["doc_id"] is not None]
    assert [(r["model"], r["saved_stages"]) for r in results] == [("logistic_regression", 2)]
    _, test = split(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", 0.25)
    assert {(r["doc_id"], r["actual"]) for r in told} == {(r["doc_id"], r["quality"]) for r in test.collect()} and told
    assert len(told) == test.count() and {r["model"] for r in told} == {"logistic_regression"}
    hits = sum(r["predicted_class"] == str(r["actual"]) for r in told)
    assert abs(hits / len(told) - results[0]["accuracy"]) < 1e-6
    assert all(50 <= r["probability_pct"] <= 100 for r in told)


@pytest.mark.parametrize("classes", [0, 3])
def test_larger_nodes_are_split_in_a_task_as_by_passes(spark, monkeypatch, classes):
    """Nodes of up to eight times local_rows take no pass over the table, and
    the trees are those of passes."""
    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(700, 3)), 2)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = rng.integers(0, 3, 700) if classes else np.nan_to_num(x[:, 0]) * 3 + rng.normal(size=700)
    df, _ = _data(spark, x, y)
    got, passes, splits = [], [], forest._splits
    monkeypatch.setattr(forest, "_splits", lambda *a: passes.append(1) or splits(*a))
    for nodes in (1, 8):
        monkeypatch.setattr(forest, "TASK_NODES", nodes)
        model = forest.Forest({"classes": classes, "trees": 3, "local_rows": 100}).fit(df)
        got.append((len(passes), _scored(model, df, "prediction")["prediction"].to_numpy(), model.featureImportances.toArray(), model.depth))
    assert got[0][0] > 3 and got[1][0] == got[0][0]
    assert np.allclose(got[0][1], got[1][1]) and got[0][3] == got[1][3]
    assert np.allclose(got[0][2], got[1][2], atol=0.01)       # gains of passes count rows, those of tasks drawn rows
