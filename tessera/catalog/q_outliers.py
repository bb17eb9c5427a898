"""OUT1-OUT9 over the driver tables. ``events.value`` and
``documents.n_chars`` are the columns with IQR outliers."""

from pyspark.sql import functions as F

from tessera.catalog.registry import register, table
from tessera.operators import outliers as O

R = 6  # decimals kept on computed doubles, both sides


def _lineitem_typed(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                     "l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("is_open"))


@register("out1_feature_types", oracle="""
SELECT * FROM (VALUES ('l_returnflag', 'non_numeric', NULL::BIGINT)) t(column_name, feature_type, n_unique)
UNION ALL
SELECT column_name,
       CASE WHEN n_unique <= 2 THEN 'binary' WHEN n_unique <= 10 THEN 'low_cardinality'
            ELSE 'continuous' END AS feature_type, n_unique
FROM (
  SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS n_unique FROM lineitem
  UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem
  UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem
  UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem
  UNION ALL SELECT 'is_open', count(DISTINCT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) FROM lineitem
)
""")
def out1_feature_types(spark, d):
    return O.feature_types(_lineitem_typed(spark, d))


_EVENTS_BOUNDS = """
WITH q AS (
  SELECT quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3,
         quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3
  FROM events),
b AS (
  SELECT u1 - 1.5 * (u3 - u1) AS ulo, u3 + 1.5 * (u3 - u1) AS uhi,
         v1 - 1.5 * (v3 - v1) AS vlo, v3 + 1.5 * (v3 - v1) AS vhi FROM q)
"""


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@register("out2_detect_outliers", oracle=_EVENTS_BOUNDS + """
SELECT e.event_id, e.user_id, e.event_type, e.value
FROM events e, b
WHERE e.user_id < b.ulo OR e.user_id > b.uhi OR e.value < b.vlo OR e.value > b.vhi
""")
def out2_detect_outliers(spark, d):
    return O.detect_outliers(_events(spark, d), exclude="event_id")


@register("out3_outlier_details", oracle=_EVENTS_BOUNDS + """
SELECT e.event_id, 'value' AS column_name, e.value AS value,
       round(b.vlo, 6) AS lower, round(b.vhi, 6) AS upper
FROM events e, b WHERE e.value < b.vlo OR e.value > b.vhi
UNION ALL
SELECT e.event_id, 'user_id', e.user_id::DOUBLE, round(b.ulo, 6), round(b.uhi, 6)
FROM events e, b WHERE e.user_id < b.ulo OR e.user_id > b.uhi
""")
def out3_outlier_details(spark, d):
    r = O.outlier_details(_events(spark, d), keys="event_id", exclude="event_id")
    return r.select("event_id", "column_name", "value",
                    F.round("lower", R).alias("lower"), F.round("upper", R).alias("upper"))


_DOC_BOUNDS = """
WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@register("out4_cap_inplace", oracle=_DOC_BOUNDS + """
SELECT doc_id, lang, source,
       CASE WHEN n_chars < b.lo OR n_chars > b.hi
            THEN CAST(round_even(greatest(least(n_chars::DOUBLE, b.hi), b.lo), 0) AS BIGINT)
            ELSE n_chars END AS n_chars
FROM documents, b
""")
def out4_cap_inplace(spark, d):
    return O.cap_outliers(_docs(spark, d), target="doc_id", keep_int=True)


@register("out5_cap_audit", oracle=_DOC_BOUNDS + """
SELECT doc_id, 'n_chars' AS column_name, n_chars::DOUBLE AS value,
       round(b.lo, 6) AS lower, round(b.hi, 6) AS upper,
       round(greatest(least(n_chars::DOUBLE, b.hi), b.lo), 6) AS capped
FROM documents, b WHERE n_chars < b.lo OR n_chars > b.hi
""")
def out5_cap_audit(spark, d):
    r = O.cap_audit(_docs(spark, d), keys="doc_id", target="doc_id")
    return r.select("doc_id", "column_name", "value", F.round("lower", R).alias("lower"),
                    F.round("upper", R).alias("upper"), F.round("capped", R).alias("capped"))


@register("out6_cap_copy", oracle=_EVENTS_BOUNDS + """
SELECT event_id, event_type,
       round(greatest(least(user_id::DOUBLE, b.uhi), b.ulo), 6) AS user_id,
       round(greatest(least(value, b.vhi), b.vlo), 6) AS value
FROM events, b
""")
def out6_cap_copy(spark, d):
    r = O.cap_outliers(_events(spark, d), target="event_id", keep_int=False)
    return r.select("event_id", "event_type", F.round("user_id", R).alias("user_id"),
                    F.round("value", R).alias("value"))


@register("out6_cap_report", oracle=_EVENTS_BOUNDS + """
SELECT 'user_id' AS column_name, round(b.ulo, 6) AS lower_bound, round(b.uhi, 6) AS upper_bound,
       count(*) FILTER (WHERE user_id < b.ulo) AS below_lower,
       count(*) FILTER (WHERE user_id > b.uhi) AS above_upper,
       count(*) FILTER (WHERE user_id < b.ulo OR user_id > b.uhi) AS values_capped
FROM events, b GROUP BY b.ulo, b.uhi
UNION ALL
SELECT 'value', round(b.vlo, 6), round(b.vhi, 6),
       count(*) FILTER (WHERE value < b.vlo), count(*) FILTER (WHERE value > b.vhi),
       count(*) FILTER (WHERE value < b.vlo OR value > b.vhi)
FROM events, b GROUP BY b.vlo, b.vhi
""")
def out6_cap_report(spark, d):
    r = O.cap_report(_events(spark, d), target="event_id")
    return r.select("column_name", F.round("lower_bound", R).alias("lower_bound"),
                    F.round("upper_bound", R).alias("upper_bound"),
                    "below_lower", "above_upper", "values_capped")


@register("out7_remove_outliers", oracle=_EVENTS_BOUNDS + """
SELECT e.event_id, e.user_id, e.event_type, e.value
FROM events e, b
WHERE NOT (e.user_id < b.ulo OR e.user_id > b.uhi OR e.value < b.vlo OR e.value > b.vhi)
""")
def out7_remove_outliers(spark, d):
    return O.remove_outliers(_events(spark, d), exclude="event_id")


@register("out8_apply_edits", oracle=_EVENTS_BOUNDS + """
, edits AS (SELECT event_id, value * 0.5 AS value FROM events, b
            WHERE value < b.vlo OR value > b.vhi)
SELECT e.event_id, e.user_id, e.event_type, coalesce(x.value, e.value) AS value
FROM events e LEFT JOIN edits x USING (event_id)
""")
def out8_apply_edits(spark, d):
    ev = _events(spark, d)
    det = O.outlier_details(ev, keys="event_id", exclude="event_id")
    edits = (det.where(F.col("column_name") == "value")
                .select("event_id", (F.col("value") * 0.5).alias("value")))
    return O.apply_edits(ev, edits, keys="event_id")


@register("out9_outlier_report", oracle=_EVENTS_BOUNDS + """
SELECT count(*) AS outlier_count, 'winsorized' AS method, count(*) AS rows_corrected
FROM events e, b
WHERE e.user_id < b.ulo OR e.user_id > b.uhi OR e.value < b.vlo OR e.value > b.vhi
""")
def out9_outlier_report(spark, d):
    return O.outlier_report(_events(spark, d), exclude="event_id")
