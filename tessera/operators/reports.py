"""Report tables (RPT1-RPT2): one-row / small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans.stats import distinct_counts


def quality_summary(raw: DataFrame, cleaned: DataFrame | None = None,
                    cleaning_report: DataFrame | None = None) -> DataFrame:
    """RPT1: original rows, rows / columns of the current table, duplicate
    rows and missing values handled (from the CLN6 report), rows retained."""
    n_raw = raw.count()
    cur = cleaned if cleaned is not None else raw
    n_cur = cur.count() if cleaned is not None else n_raw
    dup = handled = 0
    performed = cleaning_report is not None
    if performed:
        r = cleaning_report.first()
        dup, handled = r["duplicate_rows"], r["missing_handled"]
    return raw.sparkSession.createDataFrame(
        [(n_raw, n_cur, len(cur.columns), int(dup), int(handled),
          n_cur if cleaned is not None else 0, performed)],
        "original_rows long, total_rows long, total_columns int, duplicate_rows long, "
        "missing_values_handled long, clean_rows_retained long, cleaning_performed boolean")


def score_table(df: DataFrame, scores: DataFrame, feature: str = "feature",
                score: str = "score") -> DataFrame:
    """RPT2: rank by |score| (name breaks ties); a feature is categorical
    when it is a 64-bit integer column with <= 5 distinct values; bar width
    = min(|score| * 100, 100)."""
    rows = scores.select(feature, score).collect()     # one row per feature
    longs = [r[feature] for r in rows if r[feature] in df.columns
             and isinstance(df.schema[r[feature]].dataType, T.LongType)]
    nun = distinct_counts(df, longs, cap=5)
    rows.sort(key=lambda r: (-abs(r[score] or 0.0), r[feature]))
    out = []
    for i, r in enumerate(rows):
        cat = r[feature] in nun and nun[r[feature]] <= 5
        s = r[score]
        out.append((i + 1, r[feature], "Categorical" if cat else "Numerical", s,
                    None if s is None else min(abs(s) * 100, 100.0)))
    return df.sparkSession.createDataFrame(
        out, "rank int, feature string, feature_type string, score double, bar_width double")
