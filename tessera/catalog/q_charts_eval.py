"""VIZ1-VIZ7, RPT1-RPT2, TBL1-TBL2 and EVL1-EVL8, EVL10."""

from pyspark.sql import functions as F

from tessera.catalog.common import exact_line_total as _exact_line_total, round_doubles
from tessera.catalog.registry import register, table
from tessera.functions.exprs import md5_bucket
from tessera.operators import browse as B
from tessera.operators import charts as V
from tessera.operators import clean as C
from tessera.operators import evaluate as EV
from tessera.operators import reports as RP
from tessera.operators import select as SEL


# ------------------------------------------------------------------ charts
@register("viz1_histogram", oracle="""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) * 20.0 / (hi - lo)) AS INTEGER) + 1, 20) AS bin,
             count(*) AS c FROM lineitem, s GROUP BY 1),
e AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 21))
SELECT e.bin, round(lo + (e.bin - 1) * ((hi - lo) / 20), 6) AS lower, round(lo + e.bin * ((hi - lo) / 20), 6) AS upper,
       coalesce(b.c, 0) AS count
FROM e LEFT JOIN b USING (bin), s
""")
def viz1_histogram(spark, d):
    return round_doubles(V.histogram(table(spark, d, "lineitem"), "l_extendedprice", bins=20))


@register("viz2_box_stats", oracle="""
WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.event_type, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       min(e.value) FILTER (WHERE e.value BETWEEN f.lo AND f.hi) AS whisker_low,
       max(e.value) FILTER (WHERE e.value BETWEEN f.lo AND f.hi) AS whisker_high,
       count(*) FILTER (WHERE NOT (e.value BETWEEN f.lo AND f.hi)) AS n_outliers
FROM events e JOIN f USING (event_type)
GROUP BY f.event_type, f.n, f.q1, f.median, f.q3
""")
def viz2_box_stats(spark, d):
    return round_doubles(V.box_stats(table(spark, d, "events"), "value", by="event_type"))


@register("viz3_category_counts", oracle="""
SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS count FROM part
GROUP BY 1 ORDER BY count DESC, value LIMIT 15
""")
def viz3_category_counts(spark, d):
    return V.category_counts(table(spark, d, "part"), "p_size", n=15)


@register("viz4_pair_points", oracle="""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
""")
def viz4_pair_points(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return V.pair_points(o, ["o_custkey", "o_totalprice"], hue="o_orderstatus", keys="o_orderkey")


_VZ = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("viz5_correlation_matrix", oracle=" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM lineitem"
    for a in _VZ for b in _VZ))
def viz5_correlation_matrix(spark, d):
    return round_doubles(V.correlation_matrix(table(spark, d, "lineitem"), _VZ))


@register("viz6_scatter_points", oracle="""
SELECT event_id, user_id, value, event_type FROM events
""")
def viz6_scatter_points(spark, d):
    return V.scatter_points(table(spark, d, "events"), "user_id", "value", hue="event_type",
                            keys="event_id")


@register("viz7_target_distribution", oracle="""
SELECT 'categories' AS kind, CAST(l_linenumber AS VARCHAR) AS label, NULL::DOUBLE AS lower,
       NULL::DOUBLE AS upper, count(*) AS count
FROM lineitem GROUP BY 2
""")
def viz7_target_distribution(spark, d):
    return V.target_distribution(table(spark, d, "lineitem"), "l_linenumber")


@register("viz7_target_histogram", oracle="""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT least(CAST(floor((o_totalprice - lo) * 10.0 / (hi - lo)) AS INTEGER) + 1, 10) AS bin,
             count(*) AS c FROM orders, s GROUP BY 1),
e AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 11))
SELECT 'histogram' AS kind, CAST(e.bin AS VARCHAR) AS label, round(lo + (e.bin - 1) * ((hi - lo) / 10), 6) AS lower,
       round(lo + e.bin * ((hi - lo) / 10), 6) AS upper, coalesce(b.c, 0) AS count
FROM e LEFT JOIN b USING (bin), s
""")
def viz7_target_histogram(spark, d):
    return round_doubles(V.target_distribution(table(spark, d, "orders"), "o_totalprice", bins=10))


# ------------------------------------------------------------------ reports
@register("rpt1_quality_summary", oracle="""
WITH raw AS (SELECT lang, source FROM documents)
SELECT (SELECT count(*) FROM raw) AS original_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS total_rows, 2 AS total_columns,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows,
       0::BIGINT AS missing_values_handled,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS clean_rows_retained, true AS cleaning_performed
""")
def rpt1_quality_summary(spark, d):
    raw = table(spark, d, "documents").select("lang", "source")
    cleaned, report = C.clean(raw)
    return RP.quality_summary(raw, cleaned, report)


@register("rpt2_score_table", oracle="""
WITH x AS (SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice,
                  (l_linestatus = 'O')::BIGINT AS is_open FROM lineitem),
r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(covar_pop({c}, l_extendedprice) / nullif(stddev_pop({c}) * stddev_pop(l_extendedprice), 0)) AS score, "
    f"count(DISTINCT {c}) AS nd FROM x" for c in ["l_orderkey", "l_partkey", "l_quantity", "is_open"]) + """)
SELECT (row_number() OVER (ORDER BY score DESC, feature))::INTEGER AS rank, feature,
       CASE WHEN feature IN ('l_orderkey', 'l_partkey', 'is_open') AND nd <= 5 THEN 'Categorical' ELSE 'Numerical' END
         AS feature_type,
       round(score, 6) AS score, round(least(score * 100, 100), 6) AS bar_width
FROM r
""")
def rpt2_score_table(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                                            (F.col("l_linestatus") == "O").cast("long").alias("is_open"))
    scores = SEL.correlation_with_target(li, "l_extendedprice")
    return round_doubles(RP.score_table(li, scores))


# ------------------------------------------------------------------ browse
@register("tbl1_search_rows", oracle="""
SELECT * FROM customer
WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'ma') OR contains(lower(c_name), 'ma')
   OR contains(lower(CAST(c_nationkey AS VARCHAR)), 'ma') OR contains(lower(CAST(c_acctbal AS VARCHAR)), 'ma')
   OR contains(lower(c_mktsegment), 'ma')
""")
def tbl1_search_rows(spark, d):
    return B.search_rows(table(spark, d, "customer"), "MA")


@register("tbl2_sort_rows", oracle="""
SELECT o_orderkey, o_orderpriority, o_totalprice,
       (row_number() OVER (ORDER BY o_totalprice DESC, CAST(o_totalprice AS VARCHAR) DESC, o_orderkey) - 1)::INTEGER
         AS position
FROM orders
""")
def tbl2_sort_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return B.sort_rows(o, "o_totalprice", ascending=False, keys="o_orderkey") \
        .select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("position").cast("int"))


# -------------------------------------------------------------- evaluation
def _bin_pred(spark, d):
    """labels ⋈ documents: label = quality; prediction = 1 - toxic; score
    rises with document length (ties on equal lengths)."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    return j.select("doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"),
                    (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))


BIN = """WITH bp AS (SELECT l.doc_id, l.quality AS label, 1 - l.toxic AS prediction,
                           d.n_chars / (d.n_chars + 1000.0) AS score
                    FROM labels l JOIN documents d USING (doc_id))
"""


def _multi_pred(spark, d):
    """embeddings.label (10 classes); prediction = label for ~70 % of rows
    (md5 bucket), else (label + 3) mod 10; probability: 0.55 on the
    predicted class, 0.05 elsewhere (many ties)."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    pred = F.when(md5_bucket("vec_id", 100) < 70, F.col("label")).otherwise(F.pmod(F.col("label") + 3, F.lit(10)))
    e = e.select("vec_id", "label", pred.alias("prediction"))
    return e.select("*", F.array(*[F.when(F.col("prediction") == c, 0.55).otherwise(0.05) for c in range(10)])
                    .alias("probability"))


MULTI = """WITH mp AS (SELECT vec_id, label,
     CASE WHEN ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 70 THEN label
          ELSE (label + 3) % 10 END AS prediction FROM embeddings)
"""


def _cm_sql(rel):
    return f"""classes AS (SELECT label AS c FROM {rel} UNION SELECT prediction FROM {rel}),
pc AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
              count(*) FILTER (WHERE prediction = c) AS pred_c, count(*) FILTER (WHERE label = c) AS true_c
       FROM classes, {rel} GROUP BY c),
m AS (SELECT c, tp, pred_c, true_c, CASE WHEN pred_c > 0 THEN tp / pred_c ELSE 0 END AS prec,
             CASE WHEN true_c > 0 THEN tp / true_c ELSE 0 END AS rec FROM pc),
mf AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM m)"""


def _metrics_sql(rel):
    return f""", {_cm_sql(rel)}
SELECT round(sum(tp) / sum(true_c), 6) AS accuracy, round(sum(prec * true_c) / sum(true_c), 6) AS precision,
       round(sum(rec * true_c) / sum(true_c), 6) AS recall, round(sum(f1 * true_c) / sum(true_c), 6) AS f1
FROM mf"""


@register("evl1_classification_metrics", oracle=MULTI + _metrics_sql("mp"))
def evl1_classification_metrics(spark, d):
    return round_doubles(EV.classification_metrics(_multi_pred(spark, d)))


@register("evl1_binary_metrics", oracle=BIN + _metrics_sql("bp"))
def evl1_binary_metrics(spark, d):
    return round_doubles(EV.classification_metrics(_bin_pred(spark, d)))


@register("evl2_roc_auc_binary", oracle=BIN + """
, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label <> 1) AS nn
        FROM bp GROUP BY score),
c AS (SELECT *, sum(nn) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nn AS below FROM g)
SELECT round(sum(np * (below + 0.5 * nn)) / (sum(np) * sum(nn)), 6) AS roc_auc FROM c
""")
def evl2_roc_auc_binary(spark, d):
    return round_doubles(EV.roc_auc_table(_bin_pred(spark, d), "label", "score"))


@register("evl2_roc_auc_ovr", oracle=MULTI + """
, s AS (SELECT label, c, CASE WHEN prediction = c THEN 0.55 ELSE 0.05 END AS score
        FROM mp, range(0, 10) t(c)),
g AS (SELECT c, score, count(*) FILTER (WHERE label = c) AS np, count(*) FILTER (WHERE label <> c) AS nn
      FROM s GROUP BY c, score),
cu AS (SELECT *, sum(nn) OVER (PARTITION BY c ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nn
                 AS below FROM g),
a AS (SELECT c, sum(np * (below + 0.5 * nn)) / (sum(np) * sum(nn)) AS auc, sum(np) AS support FROM cu GROUP BY c)
SELECT round(sum(auc * support) / sum(support), 6) AS roc_auc FROM a
""")
def evl2_roc_auc_ovr(spark, d):
    return round_doubles(EV.roc_auc_table(_multi_pred(spark, d), "label", probability="probability"))


@register("evl3_confusion_matrix", oracle=MULTI + """
, classes AS (SELECT label AS c FROM mp UNION SELECT prediction FROM mp)
SELECT a.c AS label, b.c AS prediction,
       (SELECT count(*) FROM mp WHERE mp.label = a.c AND mp.prediction = b.c) AS count
FROM classes a, classes b
""")
def evl3_confusion_matrix(spark, d):
    return EV.confusion_matrix(_multi_pred(spark, d))


@register("evl4_class_counts", oracle=MULTI + f", {_cm_sql('mp')}" + """
SELECT c AS class, tp, pred_c - tp AS fp, true_c - tp AS fn,
       (SELECT count(*) FROM mp) - tp - (pred_c - tp) - (true_c - tp) AS tn FROM mf
""")
def evl4_class_counts(spark, d):
    return EV.class_counts(_multi_pred(spark, d))


@register("evl5_classification_report", oracle=BIN + f", {_cm_sql('bp')}" + """
SELECT CAST(c AS VARCHAR) AS class, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1,
       true_c AS support FROM mf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(true_c), 6), sum(true_c)::BIGINT FROM mf
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), sum(true_c)::BIGINT FROM mf
UNION ALL SELECT 'weighted avg', round(sum(prec * true_c) / sum(true_c), 6), round(sum(rec * true_c) / sum(true_c), 6),
                 round(sum(f1 * true_c) / sum(true_c), 6), sum(true_c)::BIGINT FROM mf
""")
def evl5_classification_report(spark, d):
    return round_doubles(EV.classification_report(_bin_pred(spark, d)))


def _reg_pred(spark, d):
    """orders: actual o_totalprice vs the sum of its line prices."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = li.groupBy("l_orderkey").agg(
        _exact_line_total().alias("pred"))
    return o.join(s, o.o_orderkey == s.l_orderkey).select("o_orderkey", F.col("o_totalprice").alias("y"), "pred")


REG = """WITH rp AS (SELECT o.o_orderkey, o.o_totalprice AS y, s.pred FROM orders o JOIN
   (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) * (1 + CAST(l_tax AS DECIMAL(15,2))))::DOUBLE AS pred FROM lineitem GROUP BY l_orderkey) s
   ON o.o_orderkey = s.l_orderkey)
"""


@register("evl6_regression_metrics", oracle=REG + """
SELECT round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
       round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)), 6) AS r2 FROM rp
""")
def evl6_regression_metrics(spark, d):
    return round_doubles(EV.regression_metrics(_reg_pred(spark, d)))


@register("evl7_tolerance_accuracy", oracle=REG + """
SELECT round(avg(CASE WHEN y = 0 THEN abs(pred) <= 0.1 ELSE abs(pred - y) <= abs(y) * 0.1 END::DOUBLE) * 100, 6)
  AS accuracy_pct FROM rp
""")
def evl7_tolerance_accuracy(spark, d):
    return round_doubles(EV.tolerance_accuracy(_reg_pred(spark, d)))


@register("evl8_compare_models", oracle=MULTI + """
, preds AS (SELECT 'echo' AS model, 1 AS ord, vec_id, label, prediction FROM mp
            UNION ALL SELECT 'shifted', 2, vec_id, label, (label + 1) % 10 FROM mp
            UNION ALL SELECT 'truth', 3, vec_id, label, label FROM mp),
classes AS (SELECT DISTINCT label AS c FROM mp UNION SELECT DISTINCT prediction FROM preds),
pc AS (SELECT model, ord, c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
              count(*) FILTER (WHERE prediction = c) AS pred_c, count(*) FILTER (WHERE label = c) AS true_c
       FROM preds, classes GROUP BY model, ord, c),
m AS (SELECT *, CASE WHEN pred_c > 0 THEN tp / pred_c ELSE 0 END AS prec,
                CASE WHEN true_c > 0 THEN tp / true_c ELSE 0 END AS rec FROM pc),
f AS (SELECT model, ord, round(sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END * true_c)
                         / sum(true_c), 6) AS f1 FROM m GROUP BY model, ord)
SELECT model, ord AS "order", f1 FROM f ORDER BY f1 DESC, ord LIMIT 1
""")
def evl8_compare_models(spark, d):
    mp = _multi_pred(spark, d)
    variants = [("echo", 1, F.col("prediction")), ("shifted", 2, F.pmod(F.col("label") + 1, F.lit(10))),
                ("truth", 3, F.col("label"))]
    rows = []
    for name, order, pcol in variants:
        m = EV.classification_metrics(mp.select("label", pcol.alias("prediction"))).first()
        rows.append((name, order, round(m["f1"], 6)))
    res = spark.createDataFrame(rows, "model string, order int, f1 double")
    return EV.compare_models(res, "f1")


@register("evl10_residuals", oracle=REG + """
SELECT o_orderkey, round(y, 6) AS actual, round(pred, 6) AS predicted, round(y - pred, 6) AS residual,
       round((SELECT least(min(y), min(pred)) FROM rp), 6) AS line_min,
       round((SELECT greatest(max(y), max(pred)) FROM rp), 6) AS line_max
FROM rp
""")
def evl10_residuals(spark, d):
    return round_doubles(EV.residuals(_reg_pred(spark, d), keys=["o_orderkey"]))
