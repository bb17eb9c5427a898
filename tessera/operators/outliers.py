"""IQR outliers (OUT1-OUT9).

Pass 1 (bounded, to the driver): distinct counts capped at 10 to type the
columns, then exact quartiles of the continuous ones. Everything after that
is a row-wise projection or filter with the bounds as literals, so it runs
in one map stage, fuses into whole-stage codegen and also works on streams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import _as_set, as_list, is_integral_type, is_numeric_type
from tessera.plans.stats import aggregate, distinct_counts, quantiles, stats_input

BINARY_MAX = 2       # <= 2 distinct -> binary
LOW_CARD_MAX = 10    # 3..10 distinct -> low cardinality; above -> continuous


@dataclass
class FeatureTypes:
    binary: list = field(default_factory=list)
    low_cardinality: list = field(default_factory=list)
    continuous: list = field(default_factory=list)
    non_numeric: list = field(default_factory=list)
    n_unique: dict = field(default_factory=dict)
    profile: dict = field(default_factory=dict)   # HLL estimates + non-null counts

    def type_of(self, c: str) -> str | None:
        for name in ("binary", "low_cardinality", "continuous", "non_numeric"):
            if c in getattr(self, name):
                return name
        return None


def classify_features(df: DataFrame, target=None, exact: bool = False) -> FeatureTypes:
    """OUT1 as plain lists. Distinct counts are exact up to the thresholds;
    with ``exact=True`` they are exact everywhere (report use)."""
    skip = _as_set(target)
    ft = FeatureTypes()
    numeric = [f.name for f in df.schema.fields
               if f.name not in skip and is_numeric_type(f.dataType)]
    prof: dict = {}
    nun = distinct_counts(df, numeric, cap=None if exact else LOW_CARD_MAX, profile=prof)
    ft.profile = prof
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if f.name in nun:
            n = nun[f.name]
            ft.n_unique[f.name] = n
            if n <= BINARY_MAX:
                ft.binary.append(f.name)
            elif n <= LOW_CARD_MAX:
                ft.low_cardinality.append(f.name)
            else:
                ft.continuous.append(f.name)
        else:
            ft.non_numeric.append(f.name)
    return ft


def feature_types(df: DataFrame, target=None) -> DataFrame:
    """OUT1: long-form table ``(column_name, feature_type, n_unique)``;
    ``n_unique`` is exact and NULL for non-numeric columns."""
    ft = classify_features(df, target, exact=True)
    rows = [(c, ft.type_of(c), ft.n_unique.get(c)) for c in df.columns if ft.type_of(c)]
    schema = "column_name string, feature_type string, n_unique long"
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass
class IQRPlan:
    """Bounds of every continuous column with IQR > 0."""
    multiplier: float
    types: FeatureTypes
    bounds: dict            # col -> (lower, upper)
    quartiles: dict         # col -> (q1, q3)
    skipped_iqr_zero: list
    integral: set = field(default_factory=set)

    def outside(self, c: str) -> Column:
        """Comparison in the column's own type so parquet can take it as a
        pushed filter: for integers x < lo <=> x < ceil(lo), x > hi <=>
        x > floor(hi)."""
        lo, hi = self.bounds[c]
        x = F.col(c)
        if c in self.integral:
            return (x < F.lit(math.ceil(lo))) | (x > F.lit(math.floor(hi)))
        return (x < F.lit(lo)) | (x > F.lit(hi))

    def any_outside(self) -> Column:
        """NULL-valued cells are not outliers; in a WHERE a NULL condition
        already drops the row, so no coalesce is needed (and none blocks
        pushdown)."""
        conds = [self.outside(c) for c in self.bounds]
        if not conds:
            return F.lit(False)
        out = conds[0]
        for c in conds[1:]:
            out = out | c
        return out

    def no_outside(self) -> Column:
        """Rows to keep when removing outliers (NULL cells count as inside)."""
        return ~F.coalesce(self.any_outside(), F.lit(False))


def iqr_plan(df: DataFrame, multiplier: float = 1.5, exclude=None) -> IQRPlan:
    skip = _as_set(exclude)
    num = [f.name for f in df.schema.fields if f.name not in skip and is_numeric_type(f.dataType)]
    with stats_input(df, num) as s:
        ft = classify_features(s)
        q = quantiles(s, ft.continuous, [0.25, 0.75], counts=ft.profile.get("counts"),
                      distinct=ft.profile.get("distinct"))
    ft.non_numeric = [f.name for f in df.schema.fields if f.name not in skip and f.name not in num]
    bounds, quart, zero = {}, {}, []
    for c in ft.continuous:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        if iqr == 0:
            zero.append(c)
            continue
        quart[c] = (q1, q3)
        bounds[c] = (q1 - multiplier * iqr, q3 + multiplier * iqr)
    integral = {c for c in bounds if is_integral_type(df.schema[c].dataType)}
    return IQRPlan(multiplier, ft, bounds, quart, zero, integral)


def detect_outliers(df: DataFrame, multiplier: float = 1.5, exclude=None,
                    plan: IQRPlan | None = None) -> DataFrame:
    """OUT2: rows with any continuous column outside its IQR fences."""
    plan = plan or iqr_plan(df, multiplier, exclude)
    return df.where(plan.any_outside())


def outlier_details(df: DataFrame, keys, multiplier: float = 1.5, exclude=None,
                    plan: IQRPlan | None = None) -> DataFrame:
    """OUT3: one record per (row, column) outside the fences:
    keys..., column_name, value, lower, upper."""
    plan = plan or iqr_plan(df, multiplier, exclude)
    keys = as_list(keys)
    return _cell_records(df, keys, plan, with_capped=False)


def _cell_records(df, keys, plan, with_capped):
    spark = df.sparkSession
    if not plan.bounds:
        extra = ", capped double" if with_capped else ""
        key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
        return spark.createDataFrame(
            [], f"{key_schema}, column_name string, value double, lower double, upper double{extra}")
    cells = []
    for c, (lo, hi) in plan.bounds.items():
        x = F.col(c).cast("double")
        fields = [F.lit(c).alias("column_name"), x.alias("value"),
                  F.lit(lo).alias("lower"), F.lit(hi).alias("upper")]
        if with_capped:
            fields.append(F.greatest(F.least(x, F.lit(hi)), F.lit(lo)).alias("capped"))
        cells.append(F.when(plan.outside(c), F.struct(*fields)))
    # narrow filter first (pruned columns, codegen), then explode the few hits
    return (df.where(plan.any_outside())
              .select(*[F.col(k) for k in keys], F.explode(F.filter(F.array(*cells), lambda e: e.isNotNull())).alias("e"))
              .select(*keys, "e.*"))


def cap_outliers(df: DataFrame, multiplier: float = 1.5, target=None, keep_int: bool = True,
                 plan: IQRPlan | None = None) -> DataFrame:
    """OUT4 (``keep_int=True``, in place): only columns that had outliers are
    rewritten; integer columns are clipped as doubles, rounded half-even and
    cast back. OUT6 (``keep_int=False``, copy): every column with IQR > 0 is
    clipped and becomes double."""
    plan = plan or iqr_plan(df, multiplier, target)
    cols = list(plan.bounds)
    if keep_int and cols:
        had = aggregate(df, {c: F.count_if(plan.outside(c)) for c in cols})
        cols = [c for c in cols if had[c] > 0]
    out = []
    for f in df.schema.fields:
        if f.name not in cols:
            out.append(F.col(f.name))
            continue
        lo, hi = plan.bounds[f.name]
        clipped = F.greatest(F.least(F.col(f.name).cast("double"), F.lit(hi)), F.lit(lo))
        if keep_int and is_integral_type(f.dataType):
            clipped = F.bround(clipped, 0).cast(f.dataType)
        out.append(clipped.alias(f.name))
    return df.select(*out)


def cap_audit(df: DataFrame, keys, multiplier: float = 1.5, target=None,
              plan: IQRPlan | None = None) -> DataFrame:
    """OUT5: per capped cell: keys..., column_name, value (original), lower,
    upper, capped."""
    plan = plan or iqr_plan(df, multiplier, target)
    return _cell_records(df, as_list(keys), plan, with_capped=True)


def cap_report(df: DataFrame, multiplier: float = 1.5, target=None,
               plan: IQRPlan | None = None) -> DataFrame:
    """OUT6 report: per processed column bounds and how many values fall
    below / above (one aggregate pass)."""
    plan = plan or iqr_plan(df, multiplier, target)
    spark = df.sparkSession
    schema = ("column_name string, lower_bound double, upper_bound double, "
              "below_lower long, above_upper long, values_capped long")
    if not plan.bounds:
        return spark.createDataFrame([], schema)
    exprs = {}
    for c, (lo, hi) in plan.bounds.items():
        exprs[f"b:{c}"] = F.count_if(F.col(c) < F.lit(lo))
        exprs[f"a:{c}"] = F.count_if(F.col(c) > F.lit(hi))
    got = aggregate(df, exprs)
    rows = [(c, lo, hi, got[f"b:{c}"], got[f"a:{c}"], got[f"b:{c}"] + got[f"a:{c}"])
            for c, (lo, hi) in plan.bounds.items()]
    return spark.createDataFrame(rows, schema)


def remove_outliers(df: DataFrame, multiplier: float = 1.5, exclude=None,
                    plan: IQRPlan | None = None) -> DataFrame:
    """OUT7: keep rows with no continuous column outside its fences."""
    plan = plan or iqr_plan(df, multiplier, exclude)
    return df.where(plan.no_outside())


def apply_edits(df: DataFrame, edits: DataFrame, keys) -> DataFrame:
    """OUT8: overwrite cells of the full table with user edits, matched by
    key (the reference aligns by position; Spark has no position). Edited
    columns absent from the table are ignored; NULL in an edit keeps the old
    value. Of several edits of a key the least counts, compared column by
    column, whatever the row order. The edit table is keyed and small relative to the table; Spark
    broadcasts it when its size is under the broadcast threshold, otherwise
    it is a shuffled join on the key."""
    keys = as_list(keys)
    edit_cols = [c for c in edits.columns if c not in keys and c in df.columns]
    e = edits.groupBy(*keys).agg(F.min(F.struct(*edit_cols)).alias("__edit")) if edit_cols else edits.select(*keys).distinct()
    e = e.select(*keys, *[F.col(f"__edit.{c}").alias(f"__edit_{c}") for c in edit_cols])
    joined = df.join(e, on=keys, how="left")
    out = []
    for f in df.schema.fields:
        if f.name in edit_cols:
            out.append(F.coalesce(F.col(f"__edit_{f.name}").cast(f.dataType), F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return joined.select(*out)


def outlier_report(df: DataFrame, multiplier: float = 1.5, exclude=None, method: str = "winsorized",
                   plan: IQRPlan | None = None) -> DataFrame:
    """OUT9: one row (outlier_count, method, rows_corrected). Rows corrected
    = rows holding at least one capped value (all outlier rows when
    winsorizing, the removed rows when removing)."""
    plan = plan or iqr_plan(df, multiplier, exclude)
    n = aggregate(df, {"n": F.count_if(plan.any_outside())})["n"]
    return df.sparkSession.createDataFrame(
        [(int(n), method, int(n))], "outlier_count long, method string, rows_corrected long")
