"""Profiling (PRF1-PRF7): whole-table statistics in one or two fused
aggregate passes; results are small long-form report DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (dtype_name, is_float_type, is_integral_type,
                                       is_numeric_type)
from tessera.functions.exprs import adjusted_skewness
from tessera.plans.stats import aggregate, distinct_counts, quantiles, stats_input


def _any_null(df: DataFrame):
    if not df.columns:
        return F.lit(False)
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | F.col(c).isNull()
    return cond


def missing_summary(df: DataFrame) -> DataFrame:
    """PRF1: one row (total_cells, missing_cells, missing_pct,
    columns_affected, rows_affected); a single lazy aggregate."""
    nc = len(df.columns)
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 *[e.alias(f"m{i}") for i, e in enumerate(nulls)],
                 F.count_if(_any_null(df)).alias("rows_affected"))
    missing = sum((F.col(f"m{i}") for i in range(nc)), F.lit(0).cast("long"))
    affected = sum(((F.col(f"m{i}") > 0).cast("long") for i in range(nc)), F.lit(0).cast("long"))
    total = F.col("n") * F.lit(nc)
    return agg.select(
        total.cast("long").alias("total_cells"),
        missing.cast("long").alias("missing_cells"),
        F.when(total > 0, F.round(missing / total * 100, 2)).otherwise(F.lit(0.0)).alias("missing_pct"),
        affected.cast("long").alias("columns_affected"),
        F.col("rows_affected").cast("long").alias("rows_affected"))


def null_counts(df: DataFrame) -> DataFrame:
    """CLN3: (column_name, null_count) for every column, one pass."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, null_count long")
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(df.columns))
    return agg.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, null_count)") \
              .select("column_name", F.col("null_count").cast("long"))


IMPUTE_RULE = "analysis"   # PRF2 tiers; "pipeline" = IMP10 rule


def _recommend(is_num, missing_pct, skew, outlier_share, rule):
    if not is_num:
        return "most_frequent", "categorical column: most frequent value"
    if rule == "pipeline":
        if (outlier_share is not None and outlier_share > 0.05) or (skew is not None and abs(skew) > 1.0):
            return "median", "outliers or skew"
        return "mean", "low skew, few outliers"
    if missing_pct > 50:
        return "iterative", f"very high missingness ({missing_pct}%)"
    if missing_pct > 30:
        return "knn", f"high missingness ({missing_pct}%)"
    if outlier_share is not None and outlier_share > 0.05:
        return "median", "numeric column with outliers detected"
    if skew is not None and abs(skew) > 1.0:
        return "median", f"numeric column with high skewness ({skew})"
    return "mean", f"numeric column with low skewness ({skew}) and no significant outliers"


def missing_profile_rows(df: DataFrame, cols=None, rule: str = IMPUTE_RULE,
                         only_missing: bool = True) -> list[dict]:
    """Statistics behind PRF2/PRF3/IMP8/IMP10 for ``cols`` (default all).

    Pass 1: count, nulls, adjusted skewness per column; pass 2: exact
    quartiles; pass 3: IQR outlier counts. Returned as plain dicts (one per
    column), ordered by missing % descending (stable on column order).
    """
    cols = list(cols) if cols is not None else list(df.columns)
    with stats_input(df, cols) as s:
        return _missing_profile_rows(s, cols, rule, only_missing)


def _missing_profile_rows(df, cols, rule, only_missing):
    exprs = {"__n": F.count(F.lit(1))}
    for c in cols:
        exprs[f"m:{c}"] = F.count_if(F.col(c).isNull())
        if is_numeric_type(df.schema[c].dataType):
            exprs[f"s:{c}"] = adjusted_skewness(c)
            exprs[f"d:{c}"] = F.approx_count_distinct(F.col(c).cast("double"))
    st = aggregate(df, exprs)
    n = st["__n"]
    chosen = [c for c in cols if not only_missing or st[f"m:{c}"] > 0]
    num = [c for c in chosen if is_numeric_type(df.schema[c].dataType) and st[f"m:{c}"] < n]
    q = quantiles(df, num, [0.25, 0.75], counts={c: n - st[f"m:{c}"] for c in num},
                  distinct={c: st[f"d:{c}"] for c in num})
    oexpr = {}
    for c in num:
        q1, q3 = q[c]
        iqr = q3 - q1
        if rule == "pipeline" or iqr > 0:
            x = F.col(c).cast("double")
            oexpr[c] = F.count_if((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr)))
    oc = aggregate(df, oexpr) if oexpr else {}
    rows = []
    for c in chosen:
        dt = df.schema[c].dataType
        miss = st[f"m:{c}"]
        pct = round(miss / n * 100, 2) if n else 0.0
        is_num = is_numeric_type(dt)
        skew = raw_skew = None
        share = None
        if c in num:
            s = st[f"s:{c}"]
            raw_skew = float(s) if s is not None else None
            skew = round(raw_skew, 3) if s is not None else None
            if c in oc:
                denom = n if rule == "pipeline" else (n - miss)
                share = oc[c] / denom if denom else 0.0
        if rule == "pipeline" and not is_num:
            rec = ("most_frequent", "categorical column: most frequent value")
        elif is_num and c not in num:          # numeric, all null
            rec = ("most_frequent", "no observed values") if rule != "pipeline" else ("mean", "no observed values")
        else:
            rec = _recommend(is_num, pct, raw_skew if rule == "pipeline" else skew, share, rule)
        rows.append({
            "column_name": c, "dtype": dtype_name(dt), "total_count": n,
            "missing_count": miss, "missing_pct": pct, "is_numeric": is_num,
            "skewness": skew, "has_outliers": bool(share is not None and share > 0.05),
            "recommended": rec[0], "reason": rec[1],
        })
    rows.sort(key=lambda r: -r["missing_pct"])
    return rows


PROFILE_SCHEMA = ("column_name string, dtype string, total_count long, missing_count long, "
                  "missing_pct double, is_numeric boolean, skewness double, has_outliers boolean, "
                  "recommended string, reason string")


def missing_profile_column(df: DataFrame, col: str) -> DataFrame:
    """PRF2 for one column (reported even without nulls)."""
    rows = missing_profile_rows(df, [col], only_missing=False)
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], PROFILE_SCHEMA)


def missing_profile(df: DataFrame) -> DataFrame:
    """PRF3: PRF2 for every column with nulls, most missing first."""
    rows = missing_profile_rows(df)
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], PROFILE_SCHEMA)


def column_details(df: DataFrame, limit: int = 20) -> DataFrame:
    """PRF4: (position, column_name, dtype, missing, n_unique, sample) for
    the first ``limit`` columns; sample = smallest non-null value as text."""
    cols = df.columns[:limit]
    nun = distinct_counts(df, cols)
    st = aggregate(df, {**{f"m:{c}": F.count_if(F.col(c).isNull()) for c in cols},
                        **{f"s:{c}": F.min(F.col(c)).cast("string") for c in cols}})
    rows = [(i, c, dtype_name(df.schema[c].dataType), st[f"m:{c}"], nun[c], st[f"s:{c}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, dtype string, missing long, n_unique long, sample string")


def column_roles(df: DataFrame, max_int_categories: int = 20) -> DataFrame:
    """PRF5: (column_name, is_numeric, is_categorical); integer columns
    with <= 20 distinct values count as categorical too."""
    ints = [f.name for f in df.schema.fields if is_integral_type(f.dataType)]
    nun = distinct_counts(df, ints, cap=max_int_categories)
    rows = []
    for f in df.schema.fields:
        num = is_numeric_type(f.dataType)
        cat = (not num) or (f.name in nun and nun[f.name] <= max_int_categories)
        rows.append((f.name, num, cat))
    return df.sparkSession.createDataFrame(rows, "column_name string, is_numeric boolean, is_categorical boolean")


def task_type_of(df: DataFrame, target: str, threshold: int = 10, exact: bool = False) -> tuple[str, int]:
    """PRF7 rule: float -> regression; numeric with >= threshold distinct ->
    regression; otherwise classification. Returns (task, n_unique); values
    that the task does not depend on (of a float target) are counted only
    with ``exact``, else n_unique is -1."""
    dt = df.schema[target].dataType
    if is_float_type(dt) and not exact:
        return "regression", -1
    n = distinct_counts(df, [target])[target]
    if is_float_type(dt):
        return "regression", n
    if is_numeric_type(dt) and n >= threshold:
        return "regression", n
    return "classification", n


def task_type(df: DataFrame, target: str, threshold: int = 10) -> DataFrame:
    t, n = task_type_of(df, target, threshold, exact=True)
    return df.sparkSession.createDataFrame([(target, t, n)], "target string, task_type string, n_unique long")


def dataset_profile_row(df: DataFrame, target: str) -> dict:
    """PRF6 as a dict (used by AutoML's advice helper)."""
    feats = [c for c in df.columns if c != target]
    exprs = {"n": F.count(F.lit(1))}
    for c in feats:
        exprs[f"m:{c}"] = F.count_if(F.col(c).isNull())
    st = aggregate(df, exprs)
    n = st["n"]
    nf = len(feats)
    total = n * nf
    missing = sum(st[f"m:{c}"] for c in feats)
    task, _ = task_type_of(df, target)
    n_classes, ratio, imbalance = None, 1.0, False
    if task == "classification":
        vc = (df.where(F.col(target).isNotNull()).groupBy(target).count()
                .agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("hi"), F.min("count").alias("lo"))
                .first())
        n_classes = int(vc["k"])
        if n_classes >= 2:
            ratio = round(vc["hi"] / vc["lo"], 2)
            imbalance = ratio > 3.0
    num = [c for c in feats if is_numeric_type(df.schema[c].dataType)]
    cat = [c for c in feats if isinstance(df.schema[c].dataType, T.StringType)]
    return {
        "n_rows": n, "n_features": nf,
        "missing_pct": round(missing / total * 100, 2) if total else 0.0,
        "task_type": task, "n_classes": n_classes,
        "has_class_imbalance": imbalance, "imbalance_ratio": float(ratio),
        "is_large_dataset": n > 50_000, "is_very_large_dataset": n > 500_000,
        "is_small_dataset": n < 500, "is_high_dimensional": nf > 50,
        "numeric_feature_ratio": round(len(num) / max(nf, 1), 2),
        "has_mixed_types": bool(cat) and bool(num),
        "n_numeric_features": len(num), "n_categorical_features": len(cat),
    }


PROFILE6_SCHEMA = ("n_rows long, n_features int, missing_pct double, task_type string, n_classes long, "
                   "has_class_imbalance boolean, imbalance_ratio double, is_large_dataset boolean, "
                   "is_very_large_dataset boolean, is_small_dataset boolean, is_high_dimensional boolean, "
                   "numeric_feature_ratio double, has_mixed_types boolean, n_numeric_features int, "
                   "n_categorical_features int")


def dataset_profile(df: DataFrame, target: str) -> DataFrame:
    """PRF6: one-row profile used for model advice."""
    r = dataset_profile_row(df, target)
    return df.sparkSession.createDataFrame([tuple(r.values())], PROFILE6_SCHEMA)
