"""Training, model comparison, importance, elimination and prediction
(TRN1-TRN13, EVL9, PRD1-PRD2, SEL6-SEL9) on Spark ML.

Features are assembled once into a vector column, dealt over all cores and
cached for the duration of a training loop (then unpersisted); every fit is a
distributed job. Driver loops are bounded by the number of models or features.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_list, is_float_type, is_numeric_type
from tessera.operators import evaluate as EV
from tessera.operators.boosting import SoftmaxBoosting, SquareBoosting
from tessera.operators.encode import Lookups, encode_target, numbered
from tessera.operators.forest import Forest
from tessera.operators.kernel import RbfSvc, RbfSvr
from tessera.plans.stats import distinct_counts, stats_input

CLASSIFIERS = ["logistic_regression", "random_forest", "decision_tree", "svm", "naive_bayes",
               "gradient_boosting"]
REGRESSORS = ["linear_regression", "random_forest_regressor", "gradient_boosting_regressor", "svr"]

SEED = 42
FIT_THREADS = 3          # models of a comparison fitted at the same time


# ----------------------------------------------------------------- features
def numeric_features(df: DataFrame, target: str, features=None) -> list[str]:
    """Numeric columns and vector columns (one-hot of very many categories)."""
    return as_list(features) or [f.name for f in df.schema.fields if f.name != target
                                 and (is_numeric_type(f.dataType) or isinstance(f.dataType, VectorUDT))]


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    va = VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")
    number = {f.name for f in df.schema.fields if f.name in features and not isinstance(f.dataType, VectorUDT)}
    return va.transform(df.select(*[F.col(c).cast("double").alias(c) if c in number else F.col(c)
                                    for c in df.columns]))


def index_label(df: DataFrame, target: str, out: str = "label"):
    """Class label -> 0..k-1 in sorted text order (ENC11); returns
    (df, classes)."""
    base = df.select("*", F.col(target).alias("__t"))
    if out in df.columns:
        base = base.drop(out)
    enc, classes = encode_target(base, "__t", out=out)
    return enc.drop("__t").withColumn(out, F.col(out).cast("double")), classes



# ------------------------------------------------------------------ models
def make_estimator(name: str, n_classes: int = 2, seed: int = SEED):
    """Spark ML estimator for a model key (features -> 'features',
    label -> 'label')."""
    if name == "logistic_regression":
        return LogisticRegression(maxIter=1000)
    if name == "random_forest":
        return Forest({"classes": n_classes, "trees": 200, "most": "sqrt", "seed": seed})
    if name == "decision_tree":
        return Forest({"classes": n_classes, "trees": 1, "bootstrap": False, "seed": seed})
    if name == "svm":
        return RbfSvc({"classes": n_classes, "seed": seed})
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian")
    if name == "gradient_boosting":
        return SoftmaxBoosting({"classes": n_classes, "rounds": 100})
    if name == "linear_regression":
        return LinearRegression()
    if name == "random_forest_regressor":
        return Forest({"trees": 200, "seed": seed})
    if name == "gradient_boosting_regressor":
        return SquareBoosting({"rounds": 100})
    if name == "svr":
        return RbfSvr({"seed": seed})
    raise ValueError(f"unknown model {name!r}")


def fit_model(train: DataFrame, features: list[str], name: str, n_classes: int = 2):
    """Fit one model on a DataFrame that already has ``label`` and the
    feature columns. Returns a PipelineModel (assembler + estimator), so it
    scores raw rows and saves / loads as one object."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
              make_estimator(name, n_classes)]
    return Pipeline(stages=stages).fit(train)


def _fit_all(train: DataFrame, features: list[str], names: list[str], n_classes: int = 2) -> dict:
    """Fit several models on features that are assembled once, dealt over all
    cores and kept for the loop. Up to ``FIT_THREADS`` fits run side by side:
    their many small jobs leave cores idle one by one."""
    spark = train.sparkSession
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    data = assembler.transform(train).select("features", "label")
    data = data.repartition(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    data.count()

    def fit(name):
        return PipelineModel(stages=[assembler, make_estimator(name, n_classes).fit(data)])

    try:
        with ThreadPoolExecutor(FIT_THREADS) as pool:
            jobs = [(name, pool.submit(inheritable_thread_target(spark)(fit), name)) for name in names]
            return {name: job.result() for name, job in jobs}
    finally:
        data.unpersist()


def _prepare_classification(df: DataFrame, target: str, features):
    feats = numeric_features(df, target, features)
    indexed, classes = index_label(df, target)
    return indexed, feats, classes


def _confidence(pred: DataFrame) -> DataFrame:
    """max class probability when the model has one, else NULL."""
    if "probability" in pred.columns:
        return pred.withColumn("confidence", F.array_max(vector_to_array("probability")))
    return pred.withColumn("confidence", F.lit(None).cast("double"))


def _binary_score(pred: DataFrame) -> DataFrame:
    if "probability" in pred.columns:
        return pred.withColumn("score", vector_to_array("probability")[1])
    return pred.withColumn("score", vector_to_array("rawPrediction")[1])


def train_classification(train: DataFrame, test: DataFrame, target: str, features=None,
                         models=None):
    """TRN12: fit every classifier, evaluate on test (EVL1-EVL3), pick the
    best by weighted F1 (first wins ties). Returns (results_df, best_name,
    fitted_models: dict). ``roc_auc`` is NULL where it has no value: one class
    among the test rows, or a model without probabilities. An error ends the run."""
    models = models or CLASSIFIERS
    tr, feats, classes = _prepare_classification(train, target, features)
    look = Lookups(test.sparkSession)
    code = look.code(F.col(target).cast("string"), numbered(classes), "int", None).cast("double")
    te = look.join(test).select(*[c for c in test.columns if c != "label"], code.alias("label"))
    k = len(classes)
    rows, fitted = [], _fit_all(tr, feats, models, k)
    with stats_input(te, list(dict.fromkeys([*feats, "label"]))) as te:      # an upstream join runs once for all models
        for order, name in enumerate(models):
            scored = fitted[name].transform(te)
            pred = scored.select("label", "prediction", *[c for c in ("probability", "rawPrediction")
                                                          if c in scored.columns])
            pred = pred.persist(StorageLevel.MEMORY_AND_DISK)   # scored once, read by every metric
            m = EV.classification_metrics(pred, "label", "prediction").first()
            auc = None
            if k == 2:
                auc = EV.roc_auc(_binary_score(pred), "label", "score", positive=1.0, undefined=None)
            elif "probability" in pred.columns:
                auc = EV.roc_auc_ovr(pred.withColumn("p", vector_to_array("probability")), "label", "p",
                                     classes=[float(i) for i in range(k)], undefined=None)
            pred.unpersist()
            rows.append((name, order, m["accuracy"], m["precision"], m["recall"], m["f1"], auc))
    res = train.sparkSession.createDataFrame(
        rows, "model string, order int, accuracy double, precision double, recall double, f1 double, "
              "roc_auc double")
    best = EV.compare_models(res, "f1").first()["model"]
    return res, best, fitted


def train_regression(train: DataFrame, test: DataFrame, target: str, features=None, models=None):
    """TRN13: fit every regressor, evaluate (EVL6-EVL7), best by R^2."""
    models = models or REGRESSORS
    feats = numeric_features(train, target, features)
    tr, te = (d.withColumn("label", F.col(target).cast("double")) for d in (train, test))
    rows, fitted = [], _fit_all(tr, feats, models)
    with stats_input(te, list(dict.fromkeys([*feats, "label"]))) as te:      # an upstream join runs once for all models
        for order, name in enumerate(models):
            pred = fitted[name].transform(te).select("label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
            m = EV.regression_metrics(pred, "label", "prediction").first()
            acc = EV.tolerance_accuracy(pred, "label", "prediction").first()[0]
            pred.unpersist()
            rows.append((name, order, m["mae"], m["rmse"], m["r2"], acc))
    res = train.sparkSession.createDataFrame(
        rows, "model string, order int, mae double, rmse double, r2 double, accuracy_pct double")
    best = EV.compare_models(res, "r2").first()["model"]
    return res, best, fitted


def train(df: DataFrame, target: str, models, keys, features=None, test_fraction: float = 0.25):
    """TRN2-TRN11 entry: split by key hash, train the listed models (task
    from the target), return the results table."""
    from tessera.operators.profile import task_type_of
    from tessera.operators.split import split
    tr, te = split(df, keys, test_fraction)
    task, _ = task_type_of(df, target)
    if task == "classification":
        return train_classification(tr, te, target, features, as_list(models))[0]
    return train_regression(tr, te, target, features, as_list(models))[0]


# --------------------------------------------------------- importance, RFE
def _last_stage(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def feature_importance(model, features: list[str], spark) -> DataFrame:
    """EVL9: importances (trees) or |coefficients| (linear), descending."""
    m = _last_stage(model)
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    elif hasattr(m, "coefficientMatrix"):
        mat = m.coefficientMatrix.toArray()
        vals = [float(sum(r[j] ** 2 for r in mat)) for j in range(mat.shape[1])]
    else:
        vals = [0.0] * len(features)
    rows = sorted(zip(features, [float(v) for v in vals]), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def _task_estimator(df, target, est, n_trees=100):
    dt = df.schema[target].dataType
    nun = distinct_counts(df, [target], cap=20)[target]
    regression = is_float_type(dt) or nun > 20
    if est == "logistic":
        if regression:
            return LinearRegression(), regression
        return LogisticRegression(maxIter=500), regression
    if regression:
        return Forest({"trees": n_trees, "seed": SEED}), regression
    return Forest({"classes": df.select(target).distinct().count(), "trees": n_trees, "most": "sqrt",
                   "seed": SEED}), regression


def _labelled(df, target, regression):
    if regression:
        return df.withColumn("label", F.col(target).cast("double"))
    return index_label(df, target)[0]


def forest_rank(df: DataFrame, target: str, k: int = 5, features=None, n_trees: int = 100) -> DataFrame:
    """SEL8: one forest's importances ranked (regressor when the target is
    float or has > 20 distinct values); ``selected`` = top k."""
    feats = numeric_features(df, target, features)
    est, reg = _task_estimator(df, target, "forest", n_trees)
    data = assemble(_labelled(df, target, reg), feats)
    model = est.fit(data)
    imp = dict(zip(feats, model.featureImportances.toArray().tolist()))
    order = sorted(feats, key=lambda c: (-imp[c], c))
    rows = [(c, float(imp[c]), i + 1, i < k) for i, c in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "feature string, score double, rank int, selected boolean")


def tree_importance(df: DataFrame, target: str, k: int = 5, features=None) -> DataFrame:
    """SEL9: forest importances scaled to sum 1 (4 dp), top k selected."""
    r = forest_rank(df, target, k, features).collect()
    total = sum(x["score"] for x in r) or 1.0
    rows = [(x["feature"], round(x["score"] / total, 4), x["rank"], x["selected"]) for x in r]
    return df.sparkSession.createDataFrame(rows, "feature string, score double, rank int, selected boolean")


def rfe(df: DataFrame, target: str, k: int = 5, est: str = "forest", features=None,
        n_trees: int = 100) -> DataFrame:
    """SEL6 / SEL7: recursive elimination, one feature per round, by forest
    importance or squared (logistic) coefficients. ``score`` is the RFE
    ranking (1 = kept). Driver loop bounded by the feature count; the
    labelled data is cached across rounds."""
    feats = numeric_features(df, target, features)
    estimator, reg = _task_estimator(df, target, est, n_trees)
    cores = df.sparkSession.sparkContext.defaultParallelism
    data = assemble(_labelled(df, target, reg), feats, "all_features").select("label", "all_features")
    data = data.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    remaining = list(feats)
    eliminated = []
    try:
        while len(remaining) > k:
            part = VectorSlicer(inputCol="all_features", outputCol="features", indices=[feats.index(c) for c in remaining])
            m = estimator.fit(part.transform(data).select("label", "features"))
            if hasattr(m, "featureImportances"):
                w = m.featureImportances.toArray().tolist()
            elif hasattr(m, "coefficientMatrix"):
                mat = m.coefficientMatrix.toArray()
                w = [float(sum(row[j] ** 2 for row in mat)) for j in range(mat.shape[1])]
            else:
                w = [float(v) ** 2 for v in m.coefficients.toArray().tolist()]
            worst = min(range(len(remaining)), key=lambda i: (w[i], remaining[i]))
            eliminated.append(remaining.pop(worst))
    finally:
        data.unpersist()
    rows = [(c, 1.0, 1, True) for c in sorted(remaining)]
    for i, c in enumerate(reversed(eliminated)):
        rows.append((c, float(i + 2), i + 2, False))
    return df.sparkSession.createDataFrame(rows, "feature string, score double, rank int, selected boolean")


# -------------------------------------------------------------- prediction
def predict(model, df: DataFrame, classes: list | None = None, keys=()) -> DataFrame:
    """PRD1: batch (or streaming) scoring with a stored model: class label
    and max probability in % (2 dp), or the value (4 dp)."""
    out = model.transform(df)
    if classes is not None:
        lab = F.element_at(F.array(*[F.lit(str(c)) for c in classes]), F.col("prediction").cast("int") + 1)
        out = _confidence(out)
        return out.select(*keys, lab.alias("predicted_class"),
                          F.round(F.col("confidence") * 100, 2).alias("probability_pct"))
    return out.select(*keys, F.round("prediction", 4).alias("predicted_value"))


def save_model(model, path: str) -> str:
    """PRD2: save (overwrite) a fitted model."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
