"""Evaluation by formula (EVL1-EVL8, EVL10).

Classification metrics all derive from the confusion counts, one
``groupBy(label, prediction)``; per-class numbers and their averages are
aggregates over it in Spark, so the number of classes is not limited.
ROC-AUC is the Mann-Whitney rank sum over distinct scores with tied
scores averaged, computed with distributed running totals; regression
metrics are one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ranks import running_totals


def _counts(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Confusion counts (l, p, n) of the pairs that occur."""
    kind = pred.schema[label].dataType
    return (pred.groupBy(F.col(label).alias("l"), F.col(prediction).cast(kind).alias("p"))
                .agg(F.count(F.lit(1)).alias("n")))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class among labels and predictions: class, tp, support,
    predicted, precision, recall, f1 (0 where undefined). One pass: each
    confusion count gives a row for its label and one for its prediction."""
    z = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("l").alias("c"), F.col("n").alias("support"), z.alias("predicted"),
                 F.when(F.col("l").eqNullSafe(F.col("p")), F.col("n")).otherwise(z).alias("tp")),
        F.struct(F.col("p").alias("c"), z.alias("support"), F.col("n").alias("predicted"), z.alias("tp")))
    got = _counts(pred, label, prediction).select(F.inline(sides)).groupBy(F.col("c").alias("class")).agg(
        *[F.sum(v).alias(v) for v in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    got = got.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return got.withColumn("f1", ratio(2 * p * r, p + r))


def _weighted(column: str):
    return F.coalesce(F.try_divide(F.sum(F.col(column) * F.col("support")), F.sum("support")), F.lit(0.0))


def _accuracy():
    return F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVL1: accuracy and support-weighted precision / recall / F1 (0 where
    undefined). The classes stay a table; the result is its one-row sum."""
    return per_class(pred, label, prediction).agg(
        _accuracy().alias("accuracy"), *[_weighted(c).alias(c) for c in ("precision", "recall", "f1")])


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     zeros: bool = True) -> DataFrame:
    """EVL3: long form (label, prediction, count) over all class pairs,
    zeros included: classes^2 rows, made in Spark. ``zeros=False`` leaves
    the pairs that do not occur out, for very many classes."""
    counts = _counts(pred, label, prediction)
    if not zeros:
        return counts.select(F.col("l").alias("label"), F.col("p").alias("prediction"), F.col("n").alias("count"))
    classes = counts.select(F.explode(F.array("l", "p")).alias("label")).distinct()
    pairs = classes.crossJoin(classes.select(F.col("label").alias("prediction")))     # the result's own size
    hit = F.col("label").eqNullSafe(F.col("l")) & F.col("prediction").eqNullSafe(F.col("p"))
    return pairs.join(counts, hit, "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("count"))


def class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVL4: per class TP, FP, FN, TN."""
    per = per_class(pred, label, prediction)
    total = per.agg(F.sum("support").alias("total"))                                  # one row
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    return per.crossJoin(F.broadcast(total)).select(
        "class", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("total") - F.col("tp") - fp - fn).alias("tn"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVL5: per class precision / recall / F1 / support, then 'accuracy',
    'macro avg' and 'weighted avg' rows (class label as text)."""
    per = per_class(pred, label, prediction)
    names = ("precision", "recall", "f1")
    none = F.lit(None).cast("double")
    macro = [F.coalesce(F.avg(c), F.lit(0.0)) for c in names]
    row = lambda name, values: F.struct(F.lit(name).alias("class"), *[v.alias(c) for c, v in zip(names, values)],
                                        F.coalesce(F.sum("support"), F.lit(0)).cast("long").alias("support"))
    sums = per.agg(row("accuracy", [none, none, _accuracy()]).alias("a"), row("macro avg", macro).alias("m"),
                   row("weighted avg", [_weighted(c) for c in names]).alias("w"))
    rows = per.select(F.coalesce(F.col("class").cast("string"), F.lit("None")).alias("class"), *names, "support")
    return rows.unionByName(sums.select(F.inline(F.array("a", "m", "w"))))


def _auc_table(scored: DataFrame, group: list) -> DataFrame:
    """scored: (group..., s, pos) -> per group AUC with ties averaged."""
    g = scored.groupBy(*group, "s").agg(F.count_if(F.col("pos")).alias("np"),
                                        F.count_if(~F.col("pos")).alias("nn"))
    cum = running_totals(g, ["s"], ["nn"], group_cols=group)
    part = cum.select(*group, "np", "nn",
                      (F.col("np") * (F.col("cum_nn") - F.col("nn") + 0.5 * F.col("nn"))).alias("u"))
    return part.groupBy(*group).agg(
        F.sum("u").alias("u"), F.sum("np").alias("P"), F.sum("nn").alias("N")).select(
        *group, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N")))
                  .otherwise(F.lit(0.0)).alias("auc"), F.col("P").alias("support"), F.col("N").alias("others"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score",
            positive=None, undefined: float | None = 0.0) -> float | None:
    """EVL2 (binary): AUC of ``score`` for the positive class (default: the
    larger label). ``undefined`` when only one class is present."""
    if positive is None:
        positive = pred.agg(F.max(label)).first()[0]
    scored = pred.select(F.col(score).cast("double").alias("s"), (F.col(label) == F.lit(positive)).alias("pos"))
    r = _auc_table(scored, []).first()
    return float(r["auc"]) if r and r["support"] and r["others"] else undefined


def roc_auc_ovr(pred: DataFrame, label: str = "label", probability: str = "probability",
                classes: list | None = None, undefined: float | None = 0.0) -> float | None:
    """EVL2 (multiclass): one-vs-rest AUC per class, weighted by class share.
    ``probability`` is an array whose i-th entry belongs to ``classes[i]``
    (default: sorted distinct labels). ``undefined`` when fewer than two
    classes are present."""
    if classes is None:
        classes = sorted(r[0] for r in pred.select(label).distinct().collect())
    idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    prob = F.col(probability)
    scored = (pred.select(F.element_at(idx, F.col(label)).alias("li"), F.posexplode(prob).alias("ci", "s"))
                  .select("ci", F.col("s").cast("double").alias("s"), (F.col("li") == F.col("ci")).alias("pos")))
    rows = _auc_table(scored, ["ci"]).collect()
    total = sum(r["support"] for r in rows)
    if len([r for r in rows if r["support"] > 0]) < 2 or not total:
        return undefined
    return float(sum(r["auc"] * r["support"] for r in rows) / total)


def roc_auc_table(pred: DataFrame, label: str = "label", score: str = "score", probability: str | None = None):
    """EVL2 as a one-row DataFrame."""
    v = roc_auc_ovr(pred, label, probability) if probability else roc_auc(pred, label, score)
    return pred.sparkSession.createDataFrame([(v,)], "roc_auc double")


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """EVL6: MAE, RMSE, R^2 (1 - SS_res / SS_tot, population), one lazy agg."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    a = pred.agg(F.avg(F.abs(yy - pp)).alias("mae"), F.avg((yy - pp) * (yy - pp)).alias("mse"),
                 F.sum((yy - pp) * (yy - pp)).alias("ss_res"),
                 (F.var_pop(yy) * F.count(yy)).alias("ss_tot"))
    r2 = (F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot"))
           .when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return a.select("mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def tolerance_accuracy(pred: DataFrame, y: str = "y", p: str = "pred", tolerance: float = 0.10) -> DataFrame:
    """EVL7: % of predictions within ``tolerance`` x |actual|; actual 0 ->
    |prediction| <= tolerance."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    ok = F.when(yy == 0, F.abs(pp) <= tolerance).otherwise(F.abs(pp - yy) <= F.abs(yy) * tolerance)
    return pred.agg((F.avg(ok.cast("double")) * 100).alias("accuracy_pct"))


def compare_models(results: DataFrame, metric: str, order: str = "order") -> DataFrame:
    """EVL8: best model by ``metric`` (F1 for classifiers, R^2 for
    regressors); earlier ``order`` wins ties. ``results`` has one row per
    model, so the window is tiny."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(order))
    return results.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def residuals(pred: DataFrame, y: str = "y", p: str = "pred", keys=()) -> DataFrame:
    """EVL10: (keys, actual, predicted, residual) with the reference-line
    ends (min / max over actual and predicted) from one aggregate."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    line = pred.agg(F.least(F.min(yy), F.min(pp)).alias("lo"), F.greatest(F.max(yy), F.max(pp)).alias("hi")).first()
    return pred.select(*keys, yy.alias("actual"), pp.alias("predicted"), (yy - pp).alias("residual"),
                       F.lit(line["lo"]).cast("double").alias("line_min"),
                       F.lit(line["hi"]).cast("double").alias("line_max"))
