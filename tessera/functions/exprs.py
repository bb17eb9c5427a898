"""Column expressions shared by the operators. All JVM-side built-ins, so
they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return col(c).cast("double")


def pair_complete(x, y) -> tuple[Column, Column]:
    """x and y restricted to rows where both are present (pandas'
    pairwise-complete rule)."""
    xx, yy = as_double(x), as_double(y)
    both = xx.isNotNull() & yy.isNotNull()
    return F.when(both, xx), F.when(both, yy)


def guarded_corr(x, y) -> Column:
    """Pearson r over pairwise-complete rows; NULL (not an ANSI error)
    when either side has zero variance."""
    xx, yy = pair_complete(x, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def adjusted_skewness(c) -> Column:
    """Sample-adjusted Fisher-Pearson skewness G1 (pandas / DuckDB).

    Spark's ``skewness`` is the biased g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    NULL when n < 3; 0 for a constant column (pandas' convention).
    """
    x = as_double(c)
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .otherwise(F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0))))


def md5_unit(*keys) -> Column:
    """Stable 32-bit hash of the key(s) as an integer in [0, 2^32):
    the first 8 hex digits of md5 over the '|'-joined key text. Independent
    of partitioning, and reproducible in plain SQL."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def md5_bucket(keys, buckets: int = 100) -> Column:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return F.pmod(md5_unit(*keys), F.lit(buckets))
