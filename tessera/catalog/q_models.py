"""TRN1-TRN13, EVL9, PRD1-PRD2, SEL6-SEL9, NOI1-NOI12, PIP1-PIP3, AML1 and
the streaming replay of a fitted preprocessor."""

from pyspark.sql import functions as F

from tessera.catalog.common import (DOCS_MISSING_SQL, docs_missing, exact_line_total as _exact_line_total, round_doubles,
                                    sql_mode)
from tessera.catalog.registry import register, table
from tessera.functions.exprs import md5_bucket
from tessera.operators import noise as N
from tessera.operators import train as TR
from tessera.operators.automl import automl
from tessera.operators.prep import Preprocessor, PreprocessorModel
from tessera.operators.split import split
from tessera.sources.io import scratch_path
from tessera.streaming.replay import replay_stream


def _cls(spark, d):
    """labels ⋈ documents; binary target ``quality``."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words"))
    return lab.join(docs, "doc_id").select("doc_id", "n_chars", "words", "toxic", "quality")


def _multi(spark, d):
    """embeddings: 64 float features, 10 classes."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)], "label")


def _reg(spark, d):
    """orders ⋈ per-order line aggregates; target ``o_totalprice``."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_base"), F.avg("l_discount").alias("avg_disc"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.join(li, o.o_orderkey == li.l_orderkey).drop("l_orderkey")


# -------------------------------------------------------------------- split
_H = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT"


@register("trn1_split", oracle=f"""
SELECT CASE WHEN {_H} % 1000000 < 250000 THEN 'test' ELSE 'train' END AS side, o_orderkey, o_orderstatus FROM orders
""")
def trn1_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    tr, te = split(o, "o_orderkey", 0.25)
    return tr.select(F.lit("train").alias("side"), "*").unionByName(te.select(F.lit("test").alias("side"), "*"))


@register("trn1_stratified_split", oracle=f"""
SELECT CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS side, o_orderkey, o_orderstatus FROM (
  SELECT o_orderkey, o_orderstatus,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) AS rn,
         ceil(0.25 * count(*) OVER (PARTITION BY o_orderstatus)) AS k
  FROM orders)
""")
def trn1_stratified_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    tr, te = split(o, "o_orderkey", 0.25, stratify="o_orderstatus")
    return tr.select(F.lit("train").alias("side"), "*").unionByName(te.select(F.lit("test").alias("side"), "*"))


# ---------------------------------------------------- single-model training
def _train_one(name, regression=False):
    def q(spark, d):
        if regression:
            return round_doubles(TR.train(_reg(spark, d), "o_totalprice", [name], keys="o_orderkey"))
        return round_doubles(TR.train(_cls(spark, d), "quality", [name], keys="doc_id"))
    return q


for _id, _name in [("trn2", "logistic_regression"), ("trn3", "random_forest"), ("trn4", "decision_tree"),
                   ("trn5", "svm"), ("trn7", "gradient_boosting")]:
    register(f"{_id}_{_name}")(_train_one(_name))
for _id, _name in [("trn9", "random_forest_regressor"), ("trn10", "gradient_boosting_regressor"), ("trn11", "svr")]:
    register(f"{_id}_{_name}")(_train_one(_name, regression=True))


# Models that SQL can recompute: class means and variances, and a linear system.
def _side(key: str, cut: int) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % 1000000 >= {cut})"


_CLS_FEATURES = ["doc_id", "n_chars", "words", "toxic"]
_BAYES = f"""WITH c AS (
  SELECT l.doc_id, d.n_chars, len(string_split(d.text, ' ')) AS words, l.toxic, l.quality,
         {_side('l.doc_id', 250_000)} AS train FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({f}::DOUBLE)' for f in _CLS_FEATURES)}) AS e FROM c WHERE train),
m AS (SELECT quality AS k, ln(count(*)::DOUBLE) - ln((SELECT count(*) FROM c WHERE train)::DOUBLE) AS prior,
  {', '.join(f'avg({f}::DOUBLE) AS m_{f}, var_pop({f}::DOUBLE) + (SELECT e FROM g) AS v_{f}' for f in _CLS_FEATURES)}
  FROM c WHERE train GROUP BY quality),
lik AS (SELECT c.doc_id, c.quality, c.train, m.k, prior - 0.5 * (
  {' + '.join(f'ln(2 * pi() * v_{f}) + ({f} - m_{f}) * ({f} - m_{f}) / v_{f}' for f in _CLS_FEATURES)}) AS ll FROM c, m),
s AS (SELECT doc_id, any_value(quality) AS quality, any_value(train) AS train,
        1 / (1 + exp(max(CASE WHEN k = 0 THEN ll END) - max(CASE WHEN k = 1 THEN ll END))) AS p1 FROM lik GROUP BY doc_id),
p AS (SELECT *, (p1 > 0.5)::INT AS predicted FROM s)
"""


@register("trn6_naive_bayes", oracle=_BAYES + """
, t AS (SELECT * FROM p WHERE NOT train),
k AS (SELECT unnest([0, 1]) AS k),
per AS (SELECT k, count(*) FILTER (quality = k) AS n, count(*) FILTER (predicted = k) AS pn,
               count(*) FILTER (quality = k AND predicted = k) AS tp FROM t, k GROUP BY k),
pr AS (SELECT *, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS pre, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS rec FROM per),
auc AS (SELECT sum(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0 END) / count(*) AS auc
        FROM t a, t b WHERE a.quality = 1 AND b.quality = 0)
SELECT 'naive_bayes' AS model, 0 AS order, round(sum(tp) / sum(n), 6) AS accuracy, round(sum(pre * n) / sum(n), 6) AS precision,
  round(sum(rec * n) / sum(n), 6) AS recall,
  round(sum(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END * n) / sum(n), 6) AS f1,
  round((SELECT auc FROM auc), 6) AS roc_auc FROM pr
""")
def trn6_naive_bayes(spark, d):
    return _train_one("naive_bayes")(spark, d)


def _fit_bayes(spark, d):
    df = _cls(spark, d)
    labelled, classes = TR.index_label(df, "quality")
    tr, _ = split(labelled, "doc_id", 0.25)
    return df, TR.fit_model(tr, _CLS_FEATURES, "naive_bayes"), classes


_BAYES_SCORES = _BAYES + """
SELECT doc_id, CAST(predicted AS VARCHAR) AS predicted_class, round(greatest(p1, 1 - p1) * 100, 2) AS probability_pct FROM p
"""


@register("prd1_predict_class", oracle=_BAYES_SCORES)
def prd1_predict_class(spark, d):
    """PRD1 with a model SQL can recompute: class and probability % of every row."""
    df, model, classes = _fit_bayes(spark, d)
    return TR.predict(model, df, classes, keys=["doc_id"])


@register("prd2_save_load_class", oracle=_BAYES_SCORES)
def prd2_save_load_class(spark, d):
    df, model, classes = _fit_bayes(spark, d)
    path = TR.save_model(model, scratch_path(spark, "model"))
    return TR.predict(TR.load_model(path), df, classes, keys=["doc_id"])


_REG_FEATURES = ["o_orderkey", "n_lines", "sum_qty", "sum_base", "avg_disc"]


def _least_squares_sql() -> str:
    """Normal equations of the centred columns, solved by elimination: one
    CTE per unknown, then the values of both sides."""
    f = _REG_FEATURES
    n = len(f)
    cols = [*f, "o_totalprice"]
    sums = ", ".join(f"sum(({a} - m_{i}) * ({b} - m_{j})) AS a{i}_{j}"
                     for i, a in enumerate(f) for j, b in enumerate(cols) if j >= i)
    sql = f"""WITH r AS (
  SELECT o.o_orderkey, o.o_totalprice, s.*, {_side('o.o_orderkey', 250_000)} AS train FROM orders o JOIN (
    SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base,
           avg(l_discount) AS avg_disc FROM lineitem GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey),
mean AS (SELECT {', '.join(f'avg({c}::DOUBLE) AS m_{i}' for i, c in enumerate(cols))} FROM r WHERE train),
e0 AS (SELECT {sums} FROM r, mean WHERE train)"""
    for k in range(n):          # rows below k lose column k; the matrix stays symmetric
        keep = [f"a{i}_{j}" for i in range(k + 1) for j in range(i, n + 1)]
        down = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, n) for j in range(i, n + 1)]
        sql += f",\ne{k + 1} AS (SELECT {', '.join(keep + down)} FROM e{k})"
    last = f"e{n}"
    for k in reversed(range(n)):
        rest = "".join(f" - a{k}_{j} * b{j}" for j in range(k + 1, n))
        sql += f",\nx{k} AS (SELECT *, (a{k}_{n}{rest}) / a{k}_{k} AS b{k} FROM {last})"
        last = f"x{k}"
    value = " + ".join(f"b{i} * ({c} - m_{i})" for i, c in enumerate(f))
    return sql + f",\np AS (SELECT r.*, m_{n} + {value} AS pred FROM r, mean, {last})"


_LEAST_SQUARES = _least_squares_sql()


@register("trn8_linear_regression", oracle=_LEAST_SQUARES + """
, t AS (SELECT o_totalprice AS y, pred FROM p WHERE NOT train)
SELECT 'linear_regression' AS model, 0 AS order, round(avg(abs(y - pred)), 4) AS mae,
  round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse,
  round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 4) AS r2,
  round(avg((CASE WHEN y = 0 THEN abs(pred) <= 0.1 ELSE abs(pred - y) <= abs(y) * 0.1 END)::INT) * 100, 4) AS accuracy_pct
FROM t
""")
def trn8_linear_regression(spark, d):
    return round_doubles(TR.train(_reg(spark, d), "o_totalprice", ["linear_regression"], keys="o_orderkey"), 4)


@register("prd1_predict_value", oracle=_LEAST_SQUARES + " SELECT o_orderkey, round(round(pred, 4), 2) AS predicted_value FROM p")
def prd1_predict_value(spark, d):
    """PRD1 for a regressor, every row scored."""
    df = _reg(spark, d)
    tr, _ = split(df.withColumn("label", F.col("o_totalprice")), "o_orderkey", 0.25)
    model = TR.fit_model(tr, _REG_FEATURES, "linear_regression")
    return round_doubles(TR.predict(model, df, keys=["o_orderkey"]), 2)


@register("trn4_tree_on_training_rows", oracle=f"""
WITH c AS (SELECT l.doc_id, d.n_chars, len(string_split(d.text, ' ')) AS words, l.toxic, l.quality
           FROM labels l JOIN documents d USING (doc_id)),
u AS (SELECT n_chars, words, toxic, count(DISTINCT quality) AS k FROM c WHERE {_side('doc_id', 250_000)} GROUP BY ALL)
SELECT doc_id, CAST(quality AS VARCHAR) AS predicted_class FROM c JOIN u USING (n_chars, words, toxic)
WHERE {_side('doc_id', 250_000)} AND k = 1
""")
def trn4_tree_on_training_rows(spark, d):
    """TRN4 without a depth limit: a tree reproduces the label of every
    training row whose features belong to one class."""
    df = _cls(spark, d)
    labelled, classes = TR.index_label(df, "quality")
    tr, _ = split(labelled, "doc_id", 0.25)
    feats = ["n_chars", "words", "toxic"]
    model = TR.fit_model(tr, feats, "decision_tree")
    one = tr.groupBy(*feats).agg(F.count_distinct("quality").alias("k")).where("k = 1").drop("k")
    return TR.predict(model, tr.join(one, feats), classes, keys=["doc_id"]).drop("probability_pct")


@register("trn12_train_classification")
def trn12_train_classification(spark, d):
    df = _cls(spark, d)
    tr, te = split(df, "doc_id", 0.25)
    res, _best, _m = TR.train_classification(tr, te, "quality", ["n_chars", "words", "toxic"])
    return round_doubles(res)


@register("trn12_multiclass_logistic")
def trn12_multiclass_logistic(spark, d):
    df = _multi(spark, d)
    tr, te = split(df, "vec_id", 0.25)
    res, _best, _m = TR.train_classification(tr, te, "label", [f"e{i}" for i in range(64)])
    return round_doubles(res)


@register("trn13_train_regression")
def trn13_train_regression(spark, d):
    df = _reg(spark, d)
    tr, te = split(df, "o_orderkey", 0.2)
    res, _best, _m = TR.train_regression(tr, te, "o_totalprice", ["n_lines", "sum_qty", "sum_base", "avg_disc"])
    return round_doubles(res)


@register("evl9_feature_importance")
def evl9_feature_importance(spark, d):
    df = _reg(spark, d)
    tr, _ = split(df, "o_orderkey", 0.2)
    feats = ["n_lines", "sum_qty", "sum_base", "avg_disc"]
    model = TR.fit_model(tr.withColumn("label", F.col("o_totalprice")), feats, "random_forest_regressor")
    return TR.feature_importance(model, feats, spark)


def _fit_cls(spark, d):
    df = _cls(spark, d)
    labelled, classes = TR.index_label(df, "quality")
    tr, _ = split(labelled, "doc_id", 0.25)
    model = TR.fit_model(tr, ["n_chars", "words", "toxic"], "logistic_regression")
    return df, model, classes


@register("prd1_predict")
def prd1_predict(spark, d):
    df, model, classes = _fit_cls(spark, d)
    return TR.predict(model, df, classes, keys=["doc_id"])


@register("prd2_save_load_model")
def prd2_save_load_model(spark, d):
    df, model, classes = _fit_cls(spark, d)
    path = TR.save_model(model, scratch_path(spark, "model"))
    return TR.predict(TR.load_model(path), df, classes, keys=["doc_id"])


@register("sel6_rfe_forest")
def sel6_rfe_forest(spark, d):
    return TR.rfe(_reg(spark, d).drop("o_orderkey"), "o_totalprice", k=2, est="forest")


@register("sel7_rfe_logistic")
def sel7_rfe_logistic(spark, d):
    return TR.rfe(_cls(spark, d).drop("doc_id"), "quality", k=1, est="logistic")


@register("sel8_forest_rank")
def sel8_forest_rank(spark, d):
    return TR.forest_rank(_reg(spark, d).drop("o_orderkey"), "o_totalprice", k=2)


@register("sel9_tree_importance")
def sel9_tree_importance(spark, d):
    return TR.tree_importance(_cls(spark, d).drop("doc_id"), "quality", k=2)


# -------------------------------------------------------------- label noise
@register("noi1_noise_task", oracle="""
SELECT 'quality' AS target, CASE WHEN count(DISTINCT quality) BETWEEN 2 AND 20 THEN 'classification'
  ELSE 'regression' END AS task FROM labels
UNION ALL SELECT 'lang', 'classification' FROM (SELECT 1)
UNION ALL SELECT 'n_chars', CASE WHEN count(DISTINCT n_chars) BETWEEN 2 AND 20 THEN 'classification'
  ELSE 'regression' END FROM documents
""")
def noi1_noise_task(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, d, "labels")
    return (N.noise_task_table(lab, "quality").unionByName(N.noise_task_table(docs, "lang"))
            .unionByName(N.noise_task_table(docs, "n_chars")))


@register("noi2_detect_label_noise")
def noi2_detect_label_noise(spark, d):
    review, _report = N.detect_label_noise(_cls(spark, d), "quality", keys="doc_id")
    return review


@register("noi3_detect_regression_noise")
def noi3_detect_regression_noise(spark, d):
    review, _report = N.detect_label_noise_regression(_reg(spark, d), "o_totalprice", keys="o_orderkey")
    return review


REG = """WITH rp AS (SELECT o.o_orderkey, o.o_totalprice AS y, s.pred FROM orders o JOIN
   (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) * (1 + CAST(l_tax AS DECIMAL(15,2))))::DOUBLE AS pred FROM lineitem GROUP BY l_orderkey) s
   ON o.o_orderkey = s.l_orderkey)
"""


@register("noi3a_flag_by_residual", oracle=REG + """
, r AS (SELECT *, abs(y - pred) AS res FROM rp)
SELECT o_orderkey, y AS original_target, pred AS predicted_target, round(res, 6) AS residual,
       round(1 - res / (SELECT max(res) FROM r), 4) AS confidence
FROM r WHERE res > (SELECT quantile_cont(res, 0.9) FROM r)
""")
def noi3a_flag_by_residual(spark, d):
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = li.groupBy("l_orderkey").agg(
        _exact_line_total().alias("pred"))
    rp = o.join(s, o.o_orderkey == s.l_orderkey).select("o_orderkey", F.col("o_totalprice").alias("y"), "pred")
    return N.flag_by_residual(rp, "y", "pred", 0.9, keys=["o_orderkey"])


@register("noi4_isolation_forest")
def noi4_isolation_forest(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    review, _report = N.detect_anomalies(ev, ["user_id", "value"], "event_id", contamination=0.1, top=None)
    return review


def _review(spark, d):
    """Review table derived from the data: documents flagged toxic get the
    flipped quality as their suggested label."""
    lab = table(spark, d, "labels")
    return lab.where(F.col("toxic") == 1).select("doc_id", (1 - F.col("quality")).cast("string")
                                                 .alias("predicted_target"))


@register("noi6_apply_labels", oracle="""
SELECT doc_id, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels
""")
def noi6_apply_labels(spark, d):
    out, _changed = N.apply_labels(table(spark, d, "labels"), _review(spark, d), "doc_id", "quality")
    return out


@register("noi6_changed_count", oracle="SELECT count(*) FILTER (WHERE toxic = 1) AS changed FROM labels")
def noi6_changed_count(spark, d):
    _out, changed = N.apply_labels(table(spark, d, "labels"), _review(spark, d), "doc_id", "quality")
    return spark.createDataFrame([(changed,)], "changed long")


@register("noi7_manual_edits", oracle="""
SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE quality END AS quality, toxic FROM labels
""")
def noi7_manual_edits(spark, d):
    lab = table(spark, d, "labels")
    edits = lab.where(F.col("quality") == 0).select("doc_id", F.lit(1).alias("new_label"))
    out, _ = N.apply_labels(lab, edits, "doc_id", "quality", new_col="new_label")
    return out


@register("noi8_auto_fix", oracle="""
SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 0 ELSE quality END AS quality, toxic FROM labels
""")
def noi8_auto_fix(spark, d):
    lab = table(spark, d, "labels")
    review = lab.where(F.col("toxic") == 1).select(
        "doc_id", F.when(F.col("quality") == 0, F.lit("Review needed")).otherwise(F.lit("0")).alias("predicted_target"))
    out, _ = N.auto_fix_labels(lab, review, "doc_id", "quality")
    return out


@register("noi9_disagreement_noise")
def noi9_disagreement_noise(spark, d):
    review, _ = N.detect_label_noise(_cls(spark, d), "quality", keys="doc_id", mode="disagree", min_review=0)
    return review


@register("noi10_drop_flagged", oracle="SELECT * FROM labels WHERE toxic <> 1")
def noi10_drop_flagged(spark, d):
    return N.drop_flagged(table(spark, d, "labels"), _review(spark, d), "doc_id")


@register("noi11_drop_rows", oracle="SELECT * FROM labels WHERE quality <> 0")
def noi11_drop_rows(spark, d):
    lab = table(spark, d, "labels")
    return N.drop_rows(lab, lab.where(F.col("quality") == 0).select("doc_id"), "doc_id")


@register("noi12_noise_report", oracle="""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE toxic = 1) AS noisy_rows,
       round(count(*) FILTER (WHERE toxic = 1) / count(*) * 100, 2) AS noise_percent,
       'quality' AS target_col, 'review' AS method, count(*) FILTER (WHERE toxic = 1) > 0 AS has_noise,
       'Flagged toxic' AS detection_reason, NULL::DOUBLE AS model_train_score, NULL::DOUBLE AS model_test_score
FROM labels
""")
def noi12_noise_report(spark, d):
    return N.noise_report(_review(spark, d), table(spark, d, "labels"), "quality", "review", "Flagged toxic")


# -------------------------------------------------- fitted preprocessing
_PIP_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_PIP_OH = {"o_orderstatus_O": "(o_orderstatus = 'O')::DOUBLE", "o_orderstatus_P": "(o_orderstatus = 'P')::DOUBLE"}


def _pip_sql(fit_rel, with_target):
    exprs = {c: f"{c}::DOUBLE" for c in _PIP_NUM}
    exprs.update(_PIP_OH)
    cols = [f"round(({e} - (SELECT avg({e}) FROM {fit_rel})) / (SELECT stddev_pop({e}) FROM {fit_rel}), 6) AS {c}"
            for c, e in exprs.items()]
    if with_target:
        cols.append("o_orderpriority")
    return f"SELECT {', '.join(cols)} FROM orders"


_PIP_TRAIN = f"(SELECT * FROM orders WHERE {_H} % 100 >= 25)"


def _orders_pip(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                            "o_orderpriority")


def _pip_model(spark, d):
    o = _orders_pip(spark, d)
    return Preprocessor({"target": "o_orderpriority"}).fit(o.where(md5_bucket("o_orderkey", 100) >= 25)), o


@register("pip1_fit_transform", oracle=_pip_sql("orders", True))
def pip1_fit_transform(spark, d):
    _model, out = Preprocessor({"target": "o_orderpriority"}).fit_transform(_orders_pip(spark, d))
    return round_doubles(out)


@register("pip2_replay", oracle=_pip_sql(_PIP_TRAIN, False))
def pip2_replay(spark, d):
    model, o = _pip_model(spark, d)
    return round_doubles(model.transform(o))


@register("pip3_save_load", oracle=_pip_sql(_PIP_TRAIN, False))
def pip3_save_load(spark, d):
    model, o = _pip_model(spark, d)
    path = scratch_path(spark, "prep")
    model.write().overwrite().save(path)
    return round_doubles(PreprocessorModel.load(path).transform(o))


@register("str1_stream_replay", oracle=_pip_sql(_PIP_TRAIN, False))
def str1_stream_replay(spark, d):
    model, o = _pip_model(spark, d)
    src = f"{d.rstrip('/')}/orders.parquet"
    raw = spark.read.parquet(src)
    out = replay_stream(spark, lambda s: model.transform(s.select(*o.columns)), src, raw.schema)
    return round_doubles(out)


# ------------------------------------------------------------------ AutoML
@register("aml1_automl")
def aml1_automl(spark, d):
    res = automl(_reg(spark, d), "o_totalprice", keys="o_orderkey")
    return round_doubles(res["results"])


def _mixed(spark, d):
    """labels ⋈ documents with text columns and NULLs; target ``quality``."""
    docs = docs_missing(spark, d).where("quality is not null")
    return docs.select("doc_id", "n_chars", "chars_en", "toxic", "lang", "source", "quality")


@register("aml1_automl_mixed")
def aml1_automl_mixed(spark, d):
    """AML1 from text and NULLs to the stored winner: its predictions of
    the test side, read back from the saved model, beside the results (one
    row per model, then one per test row)."""
    path = scratch_path(spark, "automl")
    res = automl(_mixed(spark, d), "quality", keys="doc_id", save_path=path)
    best = TR.load_model(path)
    told = TR.predict(best, res["test"], res["classes"], keys=["doc_id", F.col("quality").alias("actual")])
    out = res["results"].withColumn("saved_stages", F.lit(len(best.stages))).unionByName(
        told.withColumn("model", F.lit(res["best_model"])), allowMissingColumns=True)
    return round_doubles(out)


# PIP with all four stages at work: NULLs filled by four methods, text encoded
# two ways, three features kept by correlation, then scaled.
_PIP_MIXED = {"target": "quality", "imputation": {"n_chars": "median", "chars_en": "mean", "lang": "most_frequent",
                                                  "source": {"method": "constant", "fill_value": "none"}},
              "encoding": {"lang": "onehot", "source": "frequency"}, "selection": {"method": "correlation", "k": 3}}
_PIP_FEATURES = ["n_chars", "chars_en", "toxic", "source", "lang_es", "lang_fr"]


def _pip_mixed_sql(fit: str) -> str:
    """Long form (doc_id, feature, value) of the features kept, learned on
    the rows where ``fit`` holds."""
    f = f"(SELECT * FROM t WHERE {fit})"
    one = " UNION ALL ".join(f"SELECT doc_id, fit, quality, '{c}' AS feature, {c}::DOUBLE AS x FROM e" for c in _PIP_FEATURES)
    return f"""WITH {DOCS_MISSING_SQL},
t AS (SELECT doc_id, n_chars, chars_en, toxic, lang, source, quality, {fit} AS fit FROM dm WHERE quality IS NOT NULL),
u AS (SELECT doc_id, fit, quality, coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM {f})) AS n_chars,
        coalesce(chars_en, (SELECT avg(chars_en) FROM {f})) AS chars_en, toxic,
        coalesce(lang, {sql_mode('lang', f)}) AS lang, coalesce(source, 'none') AS source FROM t),
q AS (SELECT source, count(*) / (SELECT count(*) FROM u WHERE fit) AS share FROM u WHERE fit GROUP BY source),
e AS (SELECT u.* EXCLUDE (source), coalesce(q.share, 0) AS source, (lang = 'es')::DOUBLE AS lang_es, (lang = 'fr')::DOUBLE AS lang_fr
      FROM u LEFT JOIN q USING (source)),
l AS ({one}),
r AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s,
             row_number() OVER (ORDER BY abs(corr(x, quality)) DESC, feature) AS rank FROM l WHERE fit GROUP BY feature)
SELECT doc_id, feature, round((x - m) / s, 6) AS value FROM l JOIN r USING (feature) WHERE rank <= 3"""


def _long(df):
    cols = [c for c in df.columns if c not in ("doc_id", "quality")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols]))
    return round_doubles(df.select("doc_id", pairs.alias("p")).select("doc_id", "p.feature", "p.value"))


@register("pip1_fit_transform_mixed", oracle=_pip_mixed_sql("true"))
def pip1_fit_transform_mixed(spark, d):
    df = _mixed(spark, d)
    model = Preprocessor(_PIP_MIXED).fit(df.drop("doc_id"))
    return _long(model.transform_keep_target(df, keep=["doc_id"]))


@register("pip2_replay_mixed", oracle=_pip_mixed_sql(f"{_H.replace('o_orderkey', 'doc_id')} % 100 >= 25"))
def pip2_replay_mixed(spark, d):
    df = _mixed(spark, d)
    model = Preprocessor(_PIP_MIXED).fit(df.where(md5_bucket("doc_id", 100) >= 25).drop("doc_id"))
    return _long(model.transform_keep_target(df, keep=["doc_id"]))


@register("pip3_save_load_mixed", oracle=_pip_mixed_sql(f"{_H.replace('o_orderkey', 'doc_id')} % 100 >= 25"))
def pip3_save_load_mixed(spark, d):
    df = _mixed(spark, d)
    path = scratch_path(spark, "prep")
    Preprocessor(_PIP_MIXED).fit(df.where(md5_bucket("doc_id", 100) >= 25).drop("doc_id")).write().overwrite().save(path)
    return _long(PreprocessorModel.load(path).transform_keep_target(df, keep=["doc_id"]))


@register("noi4_rare_class")
def noi4_rare_class(spark, d):
    """NOI4 as NOI2 reaches it: a class with one row, so the isolation
    forest lists the most anomalous rows instead of a classifier's doubts."""
    df = _cls(spark, d)
    first = df.agg(F.min("doc_id")).first()[0]
    rare = df.withColumn("quality", F.when(F.col("doc_id") == first, F.lit(9)).otherwise(F.col("quality")))
    review, _report = N.detect_label_noise(rare, "quality", keys="doc_id")
    return review


@register("str2_stream_predict")
def str2_stream_predict(spark, d):
    """PRD1 on a stream: the fitted classifier scores documents as they
    arrive (availableNow over the documents file, joined to word counts
    inside the stream) and the sink is read back."""
    df, model, classes = _fit_cls(spark, d)
    src = f"{d.rstrip('/')}/documents.parquet"
    raw = spark.read.parquet(src)
    lab = table(spark, d, "labels").select("doc_id", "toxic")

    def score(stream):
        feats = stream.select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words")).join(lab, "doc_id")
        return TR.predict(model, feats, classes, keys=["doc_id"])
    return replay_stream(spark, score, src, raw.schema)


@register("trn8_linear_regression_slope", oracle="""
WITH r AS (SELECT o.o_totalprice AS y, s.sum_base AS x FROM orders o JOIN
   (SELECT l_orderkey, sum(l_extendedprice) AS sum_base FROM lineitem GROUP BY l_orderkey) s
   ON o.o_orderkey = s.l_orderkey)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept FROM r
""")
def trn8_linear_regression_slope(spark, d):
    """TRN8, bounded sub-case: a one-feature least-squares fit (Spark ML's
    normal-equation solver) equals SQL's regr_slope / regr_intercept."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = _reg(spark, d).select(F.col("o_totalprice").alias("label"), "sum_base")
    data = VectorAssembler(inputCols=["sum_base"], outputCol="features").transform(df)
    m = LinearRegression(solver="normal").fit(data)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 3))],
                                 "slope double, intercept double")
