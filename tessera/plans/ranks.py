"""Global ranks and running totals without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into
one task. Here each row gets a *bucket*: the number of sample boundaries
that sort before it, where the boundaries are quantiles of a deterministic
hash sample of the ordering tuples. A bucket is a pure function of the row,
so the per-bucket counts and the per-bucket numbering (a window partitioned
by bucket) always agree, with no persist and no checkpoint. The offsets of
earlier buckets are a table with one row per bucket (broadcast). Because
the whole ordering tuple is sampled, including tie-breakers, boundaries
split even a value that holds a third of the rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PER_BUCKET = 64
NESTED_BOUNDS = 64      # boundaries compared in a nested CASE; more are searched in an array


def _spec(order_cols) -> list[tuple[str, bool]]:
    """Normalise to (column name, ascending)."""
    return [(c[0], bool(c[1])) if isinstance(c, tuple) else (c, True) for c in order_cols]


def _cmp_values(a, b, asc: bool) -> int:
    """Spark's default ordering: NULLS FIRST ascending, NULLS LAST descending."""
    if a is None or b is None:
        if a is None and b is None:
            return 0
        r = -1 if a is None else 1              # ascending: null is smallest
        return r if asc else -r
    if a == b:
        return 0
    r = -1 if a < b else 1
    return r if asc else -r


def _cmp_tuples(x, y, spec) -> int:
    for (_name, asc), a, b in zip(spec, x, y):
        r = _cmp_values(a, b, asc)
        if r:
            return r
    return 0


def _after(spec, boundary) -> Column:
    """Row sorts strictly after ``boundary`` in ``spec`` order (lexicographic,
    Spark's null placement)."""
    expr = F.lit(False)
    for (name, asc), b in reversed(list(zip(spec, boundary))):
        c = F.col(name)
        if b is None:
            gt = c.isNotNull() if asc else F.lit(False)      # asc: non-null after null
            eq = c.isNull()
        else:
            strict = (c > F.lit(b)) if asc else (c < F.lit(b))
            gt = F.coalesce(strict, F.lit(not asc))           # null: first asc / last desc
            eq = F.coalesce(c == F.lit(b), F.lit(False))
        expr = gt | (eq & expr)
    return expr


def _bucketed(df: DataFrame, spec, partitions: int) -> DataFrame:
    """Add ``__bkt`` (0..#boundaries), monotone in ``spec`` order."""
    from tessera.plans.stats import stats_input
    names = [n for n, _ in spec]
    want = max(1, partitions) * SAMPLE_PER_BUCKET
    with stats_input(df, names) as keys:          # count + sample: two passes
        n = keys.count()
        if n <= want or partitions <= 1:
            return df.withColumn("__bkt", F.lit(0))
        frac = want / n
        h = F.pmod(F.xxhash64(*[F.col(c) for c in names], F.lit(17)), F.lit(1_000_000))
        sample = [tuple(r[c] for c in names)
                  for r in keys.where(h < F.lit(int(math.ceil(frac * 1_000_000)))).collect()]
    sample.sort(key=functools.cmp_to_key(lambda a, b: _cmp_tuples(a, b, spec)))
    if not sample:
        return df.withColumn("__bkt", F.lit(0))
    step = len(sample) / partitions
    bounds = []
    for i in range(1, partitions):
        b = sample[min(len(sample) - 1, int(i * step))]
        if not bounds or _cmp_tuples(b, bounds[-1], spec) > 0:
            bounds.append(b)

    if len(bounds) > NESTED_BOUNDS:
        return _searched(df, spec, bounds)

    def search(lo: int, hi: int) -> Column:
        """Boundaries before the row among bounds[lo:hi], plus lo: a binary
        search, so each row evaluates O(log #boundaries) comparisons."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_after(spec, bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return df.withColumn("__bkt", search(0, len(bounds)))


def _searched(df: DataFrame, spec, bounds: list) -> DataFrame:
    """The same bucket for any number of boundaries: they are one broadcast
    row (an array), searched by a fold over the powers of two, so neither the
    plan nor the generated code grows with them."""
    names = [n for n, _ in spec]
    kind = T.StructType([T.StructField(f"b{i}", df.schema[n].dataType) for i, n in enumerate(names)])
    row = df.sparkSession.createDataFrame([(bounds,)], T.StructType([T.StructField("__bounds", T.ArrayType(kind))]))
    n = len(bounds)

    def step(low, power):
        at = low + power
        return F.when((at <= n) & _after_struct(spec, F.get("__bounds", at - 1)), at).otherwise(low)

    powers = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    got = df.crossJoin(F.broadcast(row))                  # one row
    return got.withColumn("__bkt", F.aggregate(powers, F.lit(0), step)).drop("__bounds")


def _after_struct(spec, b: Column) -> Column:
    """``_after`` for a boundary that is a column of structs."""
    expr = F.lit(False)
    for i, (name, asc) in reversed(list(enumerate(spec))):
        c, v = F.col(name), b.getField(f"b{i}")
        if asc:
            gt = F.coalesce(c > v, c.isNotNull() & v.isNull())
        else:
            gt = F.coalesce(c < v, c.isNull() & v.isNotNull())
        expr = gt | (c.eqNullSafe(v) & expr)
    return expr


def _order(spec):
    return [F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in spec]


def global_row_number(df: DataFrame, order_cols: list, out: str = "rank0",
                      partitions: int | None = None) -> DataFrame:
    """Append ``out`` = 0-based position of each row in ``order_cols`` order
    (names, or (name, ascending) pairs; ties must already be broken)."""
    spark = df.sparkSession
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = _spec(order_cols)
    d = _bucketed(df, spec, nparts)
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy("__bkt").orderBy(*_order(spec))))
    counts = d.groupBy("__bkt").agg(F.count(F.lit(1)).alias("__c"))
    offs = counts.select(
        "__bkt",
        F.coalesce(F.sum("__c").over(Window.orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    return (d.join(F.broadcast(offs), "__bkt")
             .select(*df.columns, (F.col("__off") + F.col("__rn") - 1).alias(out)))


def running_totals(df: DataFrame, order_cols: list, value_cols: list, group_cols: list = (),
                   partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Append inclusive running sums of ``value_cols`` in ``order_cols``
    order within ``group_cols`` (rows unique on group + order)."""
    spark = df.sparkSession
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = list(group_cols)
    d = _bucketed(df, _spec(groups + list(order_cols)), nparts)
    w = (Window.partitionBy("__bkt", *groups).orderBy(*_order(_spec(order_cols)))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for v in value_cols:
        d = d.withColumn(f"__r_{v}", F.sum(F.col(v)).over(w))
    tot = d.groupBy("__bkt", *groups).agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    wo = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))) \
        .orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__bkt", *groups, *[F.coalesce(F.sum(f"__t_{v}").over(wo), F.lit(0)).alias(f"__o_{v}")
                                          for v in value_cols])
    j = d.join(F.broadcast(offs), ["__bkt", *groups])
    return j.select(*df.columns, *[(F.col(f"__r_{v}") + F.col(f"__o_{v}")).alias(f"{prefix}{v}")
                                   for v in value_cols])
