"""PRF1-PRF7 and CLN1-CLN6 over the driver tables."""

from pyspark.sql import functions as F

from tessera.catalog.common import (DM_COLUMNS, DOCS_MISSING_SQL, docs_missing, lineitem_typed,
                                    round_doubles, sql_mode)
from tessera.catalog.registry import register, table
from tessera.operators import clean as C
from tessera.operators import profile as P

W = "WITH " + DOCS_MISSING_SQL


@register("prf1_missing_summary", oracle=W + """
, s AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE doc_id IS NULL) AS m0, count(*) FILTER (WHERE n_chars IS NULL) AS m1,
  count(*) FILTER (WHERE doc_rank IS NULL) AS m2, count(*) FILTER (WHERE chars_en IS NULL) AS m3,
  count(*) FILTER (WHERE quality IS NULL) AS m4, count(*) FILTER (WHERE toxic IS NULL) AS m5,
  count(*) FILTER (WHERE lang IS NULL) AS m6, count(*) FILTER (WHERE source IS NULL) AS m7,
  count(*) FILTER (WHERE doc_id IS NULL OR n_chars IS NULL OR doc_rank IS NULL OR chars_en IS NULL
                   OR quality IS NULL OR toxic IS NULL OR lang IS NULL OR source IS NULL) AS rows_affected
  FROM dm)
SELECT n * 8 AS total_cells, (m0+m1+m2+m3+m4+m5+m6+m7)::BIGINT AS missing_cells,
       round((m0+m1+m2+m3+m4+m5+m6+m7) / (n * 8) * 100, 2) AS missing_pct,
       ((m0>0)::INT+(m1>0)::INT+(m2>0)::INT+(m3>0)::INT+(m4>0)::INT+(m5>0)::INT+(m6>0)::INT+(m7>0)::INT)::BIGINT
         AS columns_affected,
       rows_affected
FROM s
""")
def prf1_missing_summary(spark, d):
    return P.missing_summary(docs_missing(spark, d))


def _profile_sql(col, dtype, numeric, rule="analysis"):
    if not numeric:
        rec = "'most_frequent'"
        return f"""SELECT '{col}' AS column_name, '{dtype}' AS dtype, count(*) AS total_count,
  count(*) FILTER (WHERE {col} IS NULL) AS missing_count,
  round(count(*) FILTER (WHERE {col} IS NULL) / count(*) * 100, 2) AS missing_pct,
  false AS is_numeric, NULL::DOUBLE AS skewness, false AS has_outliers, {rec} AS recommended
FROM dm"""
    return f"""SELECT * FROM (
WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE {col} IS NULL) AS m,
                  skewness({col}) AS sk, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3
           FROM dm),
     o AS (SELECT count(*) FILTER (WHERE {col} < s.q1 - 1.5 * (s.q3 - s.q1)
                                     OR {col} > s.q3 + 1.5 * (s.q3 - s.q1)) AS k FROM dm, s),
     f AS (SELECT s.*, o.k, round(s.m / s.n * 100, 2) AS pct, round(s.sk, 3) AS sk3,
                  CASE WHEN s.q3 - s.q1 > 0 THEN o.k / (s.n - s.m) > 0.05 ELSE false END AS has_out
           FROM s, o)
SELECT '{col}' AS column_name, '{dtype}' AS dtype, n AS total_count, m AS missing_count,
       pct AS missing_pct, true AS is_numeric, sk3 AS skewness, has_out AS has_outliers,
       CASE WHEN pct > 50 THEN 'iterative' WHEN pct > 30 THEN 'knn' WHEN has_out THEN 'median'
            WHEN abs(sk3) > 1 THEN 'median' ELSE 'mean' END AS recommended
FROM f)"""


_PROFILE_COLS = [c for c in DM_COLUMNS if c[0] != "doc_id"]  # doc_id has no NULLs

_PCOLS = ["column_name", "dtype", "total_count", "missing_count", "missing_pct", "is_numeric",
          "skewness", "has_outliers", "recommended"]


@register("prf2_missing_profile_column",
          oracle=W + _profile_sql("chars_en", "double", True))
def prf2_missing_profile_column(spark, d):
    return P.missing_profile_column(docs_missing(spark, d), "chars_en").select(*_PCOLS)


@register("prf3_missing_profile",
          oracle=W + "\nUNION ALL\n".join(_profile_sql(*c) for c in _PROFILE_COLS))
def prf3_missing_profile(spark, d):
    return P.missing_profile(docs_missing(spark, d)).select(*_PCOLS)


@register("prf4_column_details", oracle=W + "\nUNION ALL\n".join(
    f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype,
  count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS n_unique,
  CAST(min({c}) AS VARCHAR) AS sample FROM dm""" for i, (c, t, _) in enumerate(DM_COLUMNS)))
def prf4_column_details(spark, d):
    return P.column_details(docs_missing(spark, d))


@register("prf5_column_roles", oracle="""
SELECT * FROM (VALUES ('l_quantity', true, false), ('l_discount', true, false), ('l_tax', true, false),
                      ('l_returnflag', false, true)) t(column_name, is_numeric, is_categorical)
UNION ALL SELECT 'l_orderkey', true, count(DISTINCT l_orderkey) <= 20 FROM lineitem
UNION ALL SELECT 'l_linenumber', true, count(DISTINCT l_linenumber) <= 20 FROM lineitem
UNION ALL SELECT 'is_open', true, count(DISTINCT (l_linestatus = 'O')::INT) <= 20 FROM lineitem
""")
def prf5_column_roles(spark, d):
    return P.column_roles(lineitem_typed(spark, d))


@register("prf6_dataset_profile", oracle=W + """
, s AS (SELECT count(*) AS n,
   count(*) FILTER (WHERE doc_id IS NULL) + count(*) FILTER (WHERE n_chars IS NULL)
   + count(*) FILTER (WHERE doc_rank IS NULL) + count(*) FILTER (WHERE chars_en IS NULL)
   + count(*) FILTER (WHERE toxic IS NULL) + count(*) FILTER (WHERE lang IS NULL)
   + count(*) FILTER (WHERE source IS NULL) AS miss,
   count(DISTINCT quality) AS k FROM dm),
  vc AS (SELECT max(c) AS hi, min(c) AS lo FROM (SELECT quality, count(*) AS c FROM dm
         WHERE quality IS NOT NULL GROUP BY quality))
SELECT n AS n_rows, 7 AS n_features, round(miss / (n * 7) * 100, 2) AS missing_pct,
       CASE WHEN k >= 10 THEN 'regression' ELSE 'classification' END AS task_type,
       k AS n_classes, round(hi / lo, 2) > 3.0 AS has_class_imbalance, round(hi / lo, 2) AS imbalance_ratio,
       n > 50000 AS is_large_dataset, n > 500000 AS is_very_large_dataset, n < 500 AS is_small_dataset,
       false AS is_high_dimensional, round(5 / 7, 2) AS numeric_feature_ratio, true AS has_mixed_types,
       5 AS n_numeric_features, 2 AS n_categorical_features
FROM s, vc
""")
def prf6_dataset_profile(spark, d):
    return P.dataset_profile(docs_missing(spark, d), "quality")


@register("prf7_task_type", oracle="""
SELECT 'l_quantity' AS target, 'regression' AS task_type, count(DISTINCT l_quantity) AS n_unique FROM lineitem
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) >= 10 THEN 'regression'
  ELSE 'classification' END, count(DISTINCT l_linenumber) FROM lineitem
UNION ALL SELECT 'l_orderkey', CASE WHEN count(DISTINCT l_orderkey) >= 10 THEN 'regression'
  ELSE 'classification' END, count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'classification', count(DISTINCT l_returnflag) FROM lineitem
""")
def prf7_task_type(spark, d):
    li = lineitem_typed(spark, d)
    out = None
    for t in ("l_quantity", "l_linenumber", "l_orderkey", "l_returnflag"):
        r = P.task_type(li, t)
        out = r if out is None else out.unionByName(r)
    return out


@register("cln1_normalize_columns", oracle="""
SELECT c_custkey AS customer_key, c_mktsegment AS market_segment, c_acctbal AS acct_bal FROM customer
""")
def cln1_normalize_columns(spark, d):
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_mktsegment").alias("Market Segment"),
        F.col("c_acctbal").alias("Acct Bal"))
    return C.normalize_columns(cust)


@register("cln2_duplicate_count", oracle="""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS duplicate_rows
FROM documents
""")
def cln2_duplicate_count(spark, d):
    return C.duplicate_summary(table(spark, d, "documents").select("text"))


@register("cln3_null_counts", oracle=W + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM dm"
    for c, _, _ in DM_COLUMNS))
def cln3_null_counts(spark, d):
    return P.null_counts(docs_missing(spark, d))


_FILL_SQL = W + f"""
, a AS (SELECT avg(n_chars) AS n_chars, avg(doc_rank) AS doc_rank, avg(chars_en) AS chars_en,
               avg(quality) AS quality, avg(toxic) AS toxic FROM dm)
SELECT dm.doc_id,
       round(coalesce(dm.n_chars::DOUBLE, a.n_chars), 6) AS n_chars,
       round(coalesce(dm.doc_rank::DOUBLE, a.doc_rank), 6) AS doc_rank,
       round(coalesce(dm.chars_en, a.chars_en), 6) AS chars_en,
       round(coalesce(dm.quality::DOUBLE, a.quality), 6) AS quality,
       round(coalesce(dm.toxic::DOUBLE, a.toxic), 6) AS toxic,
       coalesce(dm.lang, {sql_mode('lang', 'dm')}) AS lang,
       coalesce(dm.source, {sql_mode('source', 'dm')}) AS source
FROM dm, a
"""


@register("cln4_fill_default", oracle=_FILL_SQL)
def cln4_fill_default(spark, d):
    return round_doubles(C.fill_default(docs_missing(spark, d)))


@register("cln5_drop_duplicates", oracle="SELECT DISTINCT lang, source FROM documents")
def cln5_drop_duplicates(spark, d):
    return C.drop_duplicates(table(spark, d, "documents").select("lang", "source"))


_CLEAN_IN = """
, raw AS (SELECT nullif(d.lang, 'de') AS lang, d.source, l.quality
          FROM documents d LEFT JOIN labels l USING (doc_id))
, filled AS (SELECT coalesce(lang, (SELECT lang FROM raw WHERE lang IS NOT NULL GROUP BY lang
                                   ORDER BY count(*) DESC, lang LIMIT 1)) AS lang,
                    source, coalesce(quality::DOUBLE, (SELECT avg(quality) FROM raw)) AS quality FROM raw)
"""


@register("cln6_clean_report", oracle=W + _CLEAN_IN + """
SELECT (SELECT count(*) FROM raw) AS original_rows,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows,
       (SELECT count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE quality IS NULL) FROM raw)
         AS missing_before,
       (SELECT count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE quality IS NULL) FROM raw)
         AS missing_handled,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM filled)) AS cleaned_rows,
       3 AS columns
""")
def cln6_clean_report(spark, d):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    raw = docs.join(lab, "doc_id", "left").select(
        F.when(F.col("lang") != "de", F.col("lang")).alias("Lang"),
        F.col("source").alias("Source"), F.col("quality").alias("Quality"))
    _, report = C.clean(raw)
    return report


@register("cln6_clean_table", oracle=W + _CLEAN_IN + """
SELECT DISTINCT lang, source, round(quality, 6) AS quality FROM filled
""")
def cln6_clean_table(spark, d):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    raw = docs.join(lab, "doc_id", "left").select(
        F.when(F.col("lang") != "de", F.col("lang")).alias("Lang"),
        F.col("source").alias("Source"), F.col("quality").alias("Quality"))
    out, _ = C.clean(raw)
    return round_doubles(out)
