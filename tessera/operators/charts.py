"""Chart data (VIZ1-VIZ7): the aggregates behind each chart, never the
drawing. Every result is bounded (bins, groups, top-k, hash sample)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_list, is_numeric_type
from tessera.plans.passes import summed
from tessera.plans.stats import (MAX_GROUPS, aggregate, distinct_counts, grouped_quantiles, quantiles,
                                 stats_input)


def _bucket(x, lo, hi, bins):
    """1-based equal-width bucket; the maximum goes into the last bin."""
    width_scaled = (x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)
    return F.least(F.floor(width_scaled).cast("int") + 1, F.lit(bins))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """VIZ1: (bin, lower, upper, count) for ``bins`` equal-width bins over
    [min, max]; empty bins included. NULLs ignored."""
    spark = df.sparkSession
    st = aggregate(df, {"lo": F.min(F.col(col).cast("double")), "hi": F.max(F.col(col).cast("double"))})
    lo, hi = st["lo"], st["hi"]
    schema = "bin int, lower double, upper double, count long"
    if lo is None:
        return spark.createDataFrame([], schema)
    x = F.col(col).cast("double")
    if hi == lo:
        n = df.where(x.isNotNull()).agg(F.count(F.lit(1)).alias("count"))
        return n.select(F.lit(1).alias("bin"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"),
                        F.col("count").cast("long").alias("count"))
    counts = (df.where(x.isNotNull()).groupBy(_bucket(x, lo, hi, bins).alias("bin"))
                .agg(F.count(F.lit(1)).alias("c")))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    step = (hi - lo) / bins
    return (edges.join(F.broadcast(counts), "bin", "left")
                 .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(step)).alias("lower"),
                         (F.lit(lo) + F.col("bin") * F.lit(step)).alias("upper"),
                         F.coalesce(F.col("c"), F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """VIZ2: per group q1, median, q3, whisker ends (most extreme values
    inside the 1.5 IQR fences), count and number of points beyond them.
    Quartiles are exact per group with bounded state (``grouped_quantiles``:
    a hot category never builds one big value map); whiskers take one pass
    after joining the per-group fences back (broadcast, one row per group)."""
    x = F.col(col).cast("double")
    keys = [by] if by else []
    base = df.where(x.isNotNull()).select(*keys, x.alias("__x"))
    if keys:
        qs = grouped_quantiles(df, keys, col, [0.25, 0.5, 0.75])
        counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        q = qs.join(counts, keys).select(*keys, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                                         F.col("q2").alias("q3"))
    else:
        q1, med, q3 = quantiles(df, [col], [0.25, 0.5, 0.75])[col]
        if q1 is None:
            return df.sparkSession.createDataFrame(
                [], "n long, q1 double, median double, q3 double, whisker_low double, "
                    "whisker_high double, n_outliers long")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = (F.col("__x") >= F.lit(lo)) & (F.col("__x") <= F.lit(hi))
        return base.agg(F.count(F.lit(1)).alias("n"), F.lit(q1).alias("q1"), F.lit(med).alias("median"),
                        F.lit(q3).alias("q3"), F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
                        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
                        F.count_if(~inside).cast("long").alias("n_outliers"))
    fences = q.select(*keys, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("__lo"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("__hi"))
    # fences: one row per group; broadcast only under a checked bound
    n_groups = q.count()
    joined = base.join(F.broadcast(fences) if n_groups <= MAX_GROUPS else fences, keys, "inner")
    inside = (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))
    w = joined.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    out = q.join(w, keys, "inner")
    return out.select(*keys, "n", "q1", "median", "q3", "whisker_low", "whisker_high",
                      F.col("n_outliers").cast("long").alias("n_outliers"))


def category_counts(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """VIZ3: top ``n`` values by count, value as text (NULL counted as the
    text 'None'); ties broken by value."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    return (df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col("value")).limit(n))


def _sample(df: DataFrame, keys, max_points: int | None) -> DataFrame:
    """Deterministic hash sample of about ``max_points`` rows."""
    if max_points is None:
        return df
    n = df.count()
    if n <= max_points:
        return df
    # 64-bit hash share, so that a sample of any table is not empty by rounding
    return df.where(F.xxhash64(*as_list(keys)).cast("double") / float(1 << 64) + 0.5 < F.lit(max_points / n))


def pair_points(df: DataFrame, cols=None, hue: str | None = None, keys=None,
                max_points: int | None = None) -> DataFrame:
    """VIZ4: the first five numeric columns (at least two) and an optional
    hue, of every row; ``max_points`` asks for a hash sample of about so many."""
    cols = as_list(cols) or [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    cols = cols[:5]
    if len(cols) < 2:
        raise ValueError("at least 2 numeric columns are needed for a pair plot")
    keys = as_list(keys) or cols
    sel = list(dict.fromkeys(as_list(keys) + cols + ([hue] if hue else [])))
    return _sample(df.select(*sel), keys, max_points)


CORR_BLOCK = 512   # columns on a side of one pass: 6 sums of 512 x 512


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """VIZ5: long form (col_a, col_b, r) over numeric columns, pairwise
    complete rows, NULL for zero variance. With ``x`` the values (0 where
    missing, taken off their column's mean) and ``m`` the masks, a pass adds
    up m'm, x'm, (x^2)'m and x'x: the counts, sums and products of every pair's
    complete rows. So a table of any width takes one scan for each pair of
    blocks of ``CORR_BLOCK`` columns, with or without NULLs."""
    cols = as_list(cols) or [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    base = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    with stats_input(base) as data:
        means = aggregate(data, {f"c{i}": F.avg(F.when(~F.isnan(f"c{i}"), F.col(f"c{i}"))) for i in range(len(cols))})
        r = np.full((len(cols), len(cols)), np.nan)
        blocks = [list(range(at, min(at + CORR_BLOCK, len(cols)))) for at in range(0, len(cols), CORR_BLOCK)]
        for i, left in enumerate(blocks):
            for right in blocks[i:]:
                part = _block_correlation(data, left, right, means)
                r[np.ix_(left, right)] = part
                r[np.ix_(right, left)] = part.T
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")


def _block_correlation(data: DataFrame, left: list, right: list, means: dict) -> np.ndarray:
    names = [f"c{i}" for i in dict.fromkeys([*left, *right])]
    at = {c: k for k, c in enumerate(names)}
    a, b = [at[f"c{i}"] for i in left], [at[f"c{i}"] for i in right]
    centre = np.array([means[c] or 0.0 for c in names])

    def make(batches):
        total = np.zeros((6, len(a), len(b)))
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                x = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], 1)
                m = (~np.isnan(x)).astype(np.float64)
                x = np.where(m > 0, x - centre, 0.0)
                xa, xb, ma, mb = x[:, a], x[:, b], m[:, a], m[:, b]
                total += np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])
        return total.ravel()

    n, sa, sb, qa, qb, p = summed(data.select(*names), make, 6 * len(a) * len(b)).reshape(6, len(a), len(b))
    va, vb = n * qa - sa * sa, n * qb - sb * sb
    flat = (va <= 1e-13 * n * qa) | (vb <= 1e-13 * n * qb) | (n == 0)      # rounding, not variance
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, np.nan, (n * p - sa * sb) / np.sqrt(va * vb))


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None, keys=None,
                   max_points: int | None = None) -> DataFrame:
    """VIZ6: (x, y[, hue]) points of every row; ``max_points`` asks for a
    hash sample of about so many."""
    keys = as_list(keys) or [x, y]
    sel = list(dict.fromkeys(keys + [x, y] + ([hue] if hue else [])))
    return _sample(df.select(*sel), keys, max_points)


def target_distribution(df: DataFrame, target: str, bins: int = 20) -> DataFrame:
    """VIZ7: numeric target with > 10 distinct values -> histogram, else
    category counts; one schema (kind, label, lower, upper, count)."""
    dt = df.schema[target].dataType
    nun = distinct_counts(df, [target], cap=10)[target]
    if is_numeric_type(dt) and nun > 10:
        h = histogram(df, target, bins)
        return h.select(F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("label"),
                        "lower", "upper", "count")
    c = category_counts(df, target)
    return c.select(F.lit("categories").alias("kind"), F.col("value").alias("label"),
                    F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
                    "count")

