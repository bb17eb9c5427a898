"""Cleaning (CLN1-CLN6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import is_integral_type, is_numeric_type, normalized_name
from tessera.plans.stats import aggregate, modes
from tessera.session import cut_lineage

UNKNOWN = "Unknown"   # fixed fill text when a categorical column has no mode


def normalize_columns(df: DataFrame) -> DataFrame:
    """CLN1: lower-case names, spaces -> underscores; a collision raises."""
    names = [normalized_name(c) for c in df.columns]
    seen = {}
    for old, new in zip(df.columns, names):
        if new in seen:
            raise ValueError(f"column names {seen[new]!r} and {old!r} both normalise to {new!r}")
        seen[new] = old
    return df.toDF(*names)


def duplicate_count(df: DataFrame) -> int:
    """CLN2: rows - distinct rows (NULLs equal). The dedup is one hash
    aggregate; partial aggregation collapses hot duplicates map-side."""
    st = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return st - df.distinct().count()


def duplicate_summary(df: DataFrame) -> DataFrame:
    """CLN2 as a one-row DataFrame (rows, distinct_rows, duplicate_rows)."""
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    distinct = df.distinct().count()
    return df.sparkSession.createDataFrame([(total, distinct, total - distinct)],
                                           "rows long, distinct_rows long, duplicate_rows long")


def default_fills(df: DataFrame, cols=None) -> dict:
    """Fill values of CLN4: numeric -> mean, other -> mode, 'Unknown' when
    a text column has no value at all. Only columns that contain NULLs."""
    cols = list(cols) if cols is not None else list(df.columns)
    st = aggregate(df, {**{f"m:{c}": F.count_if(F.col(c).isNull()) for c in cols},
                        **{f"a:{c}": F.avg(F.col(c).cast("double")) for c in cols
                           if is_numeric_type(df.schema[c].dataType)}})
    need = [c for c in cols if st[f"m:{c}"] > 0]
    other = [c for c in need if not is_numeric_type(df.schema[c].dataType)]
    md = modes(df, other)
    fills = {}
    for c in need:
        if is_numeric_type(df.schema[c].dataType):
            fills[c] = st[f"a:{c}"]
        else:
            fills[c] = md[c] if md[c] is not None else UNKNOWN
    return fills


def apply_fills(df: DataFrame, fills: dict) -> DataFrame:
    """coalesce(col, literal), one projection. Integer columns filled with a
    fractional value become double (as pandas does once a column holds NaN)."""
    out = []
    for f in df.schema.fields:
        v = fills.get(f.name)
        if v is None:
            out.append(F.col(f.name))
            continue
        target = f.dataType
        if is_integral_type(f.dataType) and isinstance(v, float):
            target = T.DoubleType()
        out.append(F.coalesce(F.col(f.name).cast(target), F.lit(v).cast(target)).alias(f.name))
    return df.select(*out)


def fill_default(df: DataFrame) -> DataFrame:
    """CLN4."""
    return apply_fills(df, default_fills(df))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """CLN5."""
    return df.dropDuplicates()


def _weighted_modes(rows: DataFrame, cols: list) -> dict:
    """Most frequent value per column of a table of distinct rows with
    ``__copies``; ties go to the smallest. Columns without values are left out."""
    if not cols:
        return {}
    parts = [rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.sum("__copies").alias("k"))
             .select(F.lit(i).alias("i"), "v", "k") for i, c in enumerate(cols)]
    got = {}
    for at in range(0, len(cols), 64):
        best = reduce(DataFrame.unionByName, parts[at:at + 64]).groupBy("i").agg(F.min(F.struct((-F.col("k")).alias("k"), "v")).alias("b"))
        got.update({cols[r["i"]]: r["b"]["v"] for r in best.collect()})
    return got


def clean(df: DataFrame):
    """CLN6: normalise names, count duplicates and nulls, fill, drop
    duplicates. Returns ``(cleaned_df, report_df)``; the report is one row
    (original_rows, duplicate_rows, missing_before, missing_handled,
    cleaned_rows, columns). As in the reference, ``missing_handled`` is
    counted before duplicates are dropped. Equal rows stay equal when they
    are filled, so the table is deduplicated once, before: the distinct rows
    with their counts are staged, and every number, the fills included, is an
    aggregate over that smaller table."""
    spark = df.sparkSession
    d = normalize_columns(df)
    rows = cut_lineage(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("__copies")))
    copies = F.col("__copies")
    numeric = [c for c in d.columns if is_numeric_type(d.schema[c].dataType)]
    st = aggregate(rows, {"n": F.sum(copies), "d": F.count(F.lit(1)),
                          **{f"m:{c}": F.sum(F.when(F.col(c).isNull(), copies).otherwise(0)) for c in d.columns},
                          **{f"a:{c}": F.sum(F.col(c).cast("double") * copies) for c in numeric}})
    n, missing = int(st["n"] or 0), {c: int(st[f"m:{c}"] or 0) for c in d.columns}
    missing_before, dup = sum(missing.values()), n - int(st["d"])
    need = [c for c in d.columns if missing[c]]
    tops = _weighted_modes(rows, [c for c in need if c not in numeric])
    fills = {c: (st[f"a:{c}"] / (n - missing[c]) if missing[c] < n else None) if c in numeric else tops.get(c, UNKNOWN)
             for c in need}
    missing_after = sum(missing[c] for c in need if fills[c] is None)
    filled = apply_fills(rows, fills).drop("__copies")
    out = filled.dropDuplicates() if need else filled      # filled rows can become equal
    cleaned_rows = out.count() if need else int(st["d"])
    report = spark.createDataFrame(
        [(n, dup, missing_before, missing_before - missing_after, cleaned_rows, len(out.columns))],
        "original_rows long, duplicate_rows long, missing_before long, missing_handled long, "
        "cleaned_rows long, columns int")
    return out, report
