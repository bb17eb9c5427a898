"""Fused statistics planner.

Every operator needs a handful of numbers per column (counts, means,
quartiles, modes, distinct counts) before it can build its row-wise
projection. This module computes them for *all* requested columns in as
few scans as possible, keeping each aggregate's state bounded:

* plain aggregates go into one ``agg`` (chunked so generated code stays
  small on wide tables);
* exact quantiles use Spark's ``percentile`` only where the number of
  distinct values is small enough for its value->count map; otherwise an
  approximate-bracket refinement narrows each requested rank until the
  bracket is small, then reads it exactly (same result, bounded state);
* modes and exact distinct counts use one ``groupBy`` per column, unioned
  into one job (each branch reads only its column and combines map-side)
  instead of one holistic, single-task aggregate per column.

Only a few numbers per column ever reach the driver.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import is_float_type, is_integral_type
from tessera.session import cut_lineage

AGG_CHUNK = 120                 # aggregate expressions per generated plan
EXACT_DISTINCT_LIMIT = 50_000   # percentile() map size we accept per column
APPROX_ACCURACY = 10_000         # approx_percentile accuracy during refinement
BRACKET_COLLECT_LIMIT = 100_000  # values read exactly once a bracket is this small
MAX_GROUPS = 10_000              # per-group statistics we plan for on the driver


# ------------------------------------------------------------ pass inputs
class stats_input:
    """Context for an operator that scans its input several times.

    Input that is a plain scan is re-read each pass (column-pruned parquet
    is cheap and needs no memory). Input whose plan contains a shuffle (a
    join or aggregation upstream) is persisted, pruned to the needed
    columns, for the duration of the passes and released afterwards, so the
    upstream shuffle runs once instead of once per pass.
    """

    def __init__(self, df: DataFrame, cols=None):
        self.df = df.select(*cols) if cols is not None else df
        self.cached = False

    def __enter__(self) -> DataFrame:
        try:
            plan = self.df._jdf.queryExecution().executedPlan().toString()
        except Exception:  # noqa: BLE001 - be conservative: no caching
            plan = ""
        if "Exchange" in plan:
            from pyspark import StorageLevel
            self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
            self.cached = True
        return self.df

    def __exit__(self, *exc):
        if self.cached:
            self.df.unpersist()
        return False


# ---------------------------------------------------------------- plain aggs
def aggregate(df: DataFrame, exprs: dict[str, Column], chunk: int = AGG_CHUNK) -> dict:
    """Evaluate named aggregate expressions over the whole table.

    One scan per ``chunk`` expressions; returns ``{name: value}``.
    """
    out: dict = {}
    items = list(exprs.items())
    for i in range(0, len(items), chunk):
        part = items[i:i + chunk]
        row = df.agg(*[e.alias(f"_a{j}") for j, (_, e) in enumerate(part)]).first()
        for j, (name, _) in enumerate(part):
            out[name] = row[f"_a{j}"]
    return out


# ----------------------------------------------------------------- quantiles
def _interp(lo_v, hi_v, frac):
    if lo_v is None:
        return None
    if hi_v is None or frac == 0:
        return float(lo_v)
    return float(lo_v) + frac * (float(hi_v) - float(lo_v))


def quantiles(df: DataFrame, cols: Iterable[str], probs: Iterable[float],
              counts: dict | None = None, distinct: dict | None = None,
              exact_distinct_limit: int = EXACT_DISTINCT_LIMIT,
              accuracy: int = APPROX_ACCURACY,
              collect_limit: int = BRACKET_COLLECT_LIMIT) -> dict[str, list]:
    """Exact linear-interpolated quantiles (pandas ``quantile`` / SQL
    ``percentile_cont``) of every column, NULLs ignored.

    Returns ``{col: [q(p) for p in probs]}``; ``None`` for all-null columns.
    ``counts`` (non-null rows) and ``distinct`` (HyperLogLog estimates) from
    an earlier pass let the pre-pass be skipped.
    """
    cols = list(dict.fromkeys(cols))
    probs = [float(p) for p in probs]
    if not cols:
        return {}
    x = {c: F.col(c).cast("double") for c in cols}
    pre = {}
    for c in cols:
        if counts is None or c not in counts:
            pre[f"n:{c}"] = F.count(x[c])
        if distinct is None or c not in distinct:
            pre[f"d:{c}"] = F.approx_count_distinct(x[c])
    stats = aggregate(df, pre) if pre else {}
    if distinct:
        stats.update({f"d:{c}": distinct[c] for c in cols if c in distinct})
    n = {c: (counts[c] if counts and c in counts else stats[f"n:{c}"]) for c in cols}

    result: dict[str, list] = {}
    small = [c for c in cols if n[c] and stats[f"d:{c}"] <= exact_distinct_limit]
    big = [c for c in cols if n[c] and c not in small]
    for c in cols:
        if not n[c]:
            result[c] = [None] * len(probs)
    if small:
        arr = F.array(*[F.lit(p) for p in probs])
        got = aggregate(df, {c: F.percentile(x[c], arr) for c in small})
        for c in small:
            result[c] = [float(v) if v is not None else None for v in got[c]]
    if big:
        result.update(_quantiles_by_selection(df, big, probs, n, accuracy, collect_limit))
    return result


def _quantiles_by_selection(df, cols, probs, n, accuracy, collect_limit, exprs=None):
    """Exact order statistics with bounded state.

    For each needed rank k keep a closed bracket [lo, hi] with ``below`` =
    #values < lo. Each round asks approx_percentile (rank error <= m/accuracy)
    for two values just around the target inside the bracket, then counts
    exactly; the bracket shrinks ~accuracy/6-fold per round. Once it holds
    <= collect_limit values it is read sorted and indexed exactly.
    """
    x = exprs or {c: F.col(c).cast("double") for c in cols}
    # needed ranks per column (0-based)
    state = {}
    for c in cols:
        for p in probs:
            pos = p * (n[c] - 1)
            k0 = int(math.floor(pos))
            for k in (k0, min(k0 + 1, n[c] - 1)):
                state.setdefault((c, k), {"lo": None, "hi": None, "below": 0,
                                          "m": n[c], "value": None})

    def in_bracket(c, st):
        cond = x[c].isNotNull()
        if st["lo"] is not None:
            cond = cond & (x[c] >= F.lit(st["lo"]))
        if st["hi"] is not None:
            cond = cond & (x[c] <= F.lit(st["hi"]))
        return cond

    for st in state.values():
        st["margin"] = 3.0 / accuracy
    for _round in range(64):
        pending = [key for key, st in state.items()
                   if st["value"] is None and st["m"] > collect_limit]
        if not pending:
            break
        exprs = {}
        for i, (c, k) in enumerate(pending):
            st = state[(c, k)]
            r = k - st["below"]
            q = r / max(st["m"] - 1, 1)
            qa, qb = max(0.0, q - st["margin"]), min(1.0, q + st["margin"])
            exprs[str(i)] = F.approx_percentile(
                F.when(in_bracket(c, st), x[c]), F.array(F.lit(qa), F.lit(qb)), accuracy)
        cand = aggregate(df, exprs)
        cnt = {}
        for i, (c, k) in enumerate(pending):
            st = state[(c, k)]
            va, vb = cand[str(i)]
            cnt[f"b{i}"] = F.count_if(in_bracket(c, st) & (x[c] < F.lit(va)))
            cnt[f"m{i}"] = F.count_if((x[c] >= F.lit(va)) & (x[c] <= F.lit(vb)))
        got = aggregate(df, cnt)
        for i, (c, k) in enumerate(pending):
            st = state[(c, k)]
            va, vb = cand[str(i)]
            below = st["below"] + got[f"b{i}"]
            m = got[f"m{i}"]
            if 0 <= k - below < m:
                st.update(lo=va, hi=vb, below=below, m=m)
                if va == vb:
                    st["value"] = va
            elif st["margin"] >= 1.0:
                st["force"] = True      # give up narrowing; read exactly
                st["m"] = 0
            else:                       # sketch missed: widen and retry
                st["margin"] *= 4
    # exact read of the remaining brackets (bounded)
    todo = [key for key, st in state.items() if st["value"] is None]
    if todo:
        exprs = {}
        for i, (c, k) in enumerate(todo):
            st = state[(c, k)]
            exprs[str(i)] = F.sort_array(F.collect_list(F.when(in_bracket(c, st), x[c])))
            exprs[f"b{i}"] = F.count_if(x[c] < F.lit(st["lo"])) if st["lo"] is not None else F.lit(0)
        got = aggregate(df, exprs)
        for i, (c, k) in enumerate(todo):
            st = state[(c, k)]
            vals = got[str(i)]
            r = k - got[f"b{i}"]
            st["value"] = vals[r]
    out = {}
    for c in cols:
        res = []
        for p in probs:
            pos = p * (n[c] - 1)
            k0 = int(math.floor(pos))
            k1 = min(k0 + 1, n[c] - 1)
            res.append(_interp(state[(c, k0)]["value"], state[(c, k1)]["value"], pos - k0))
        out[c] = res
    return out


def grouped_quantiles(df: DataFrame, by: list, col: str, probs: Iterable[float],
                      exact_distinct_limit: int = EXACT_DISTINCT_LIMIT,
                      accuracy: int = APPROX_ACCURACY,
                      collect_limit: int = BRACKET_COLLECT_LIMIT, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Exact per-group quantiles of ``col`` as a DataFrame (by..., q0, q1, ...).

    Groups with few distinct values take one grouped ``percentile`` pass
    (restricted to them by a broadcast semi-join of their keys). Each large
    group becomes a masked virtual column (``col`` where the row is in the
    group) in the same bracket refinement used for whole columns, so a hot
    group never builds a value->count map of its own.
    """
    probs = [float(p) for p in probs]
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull()).select(*by, x.alias("__x"))
    arr = F.array(*[F.lit(p) for p in probs])
    qcols = [f"q{i}" for i in range(len(probs))]
    stats = (base.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.approx_count_distinct("__x").alias("__d"))
                 .limit(max_groups + 1).collect())
    if len(stats) > max_groups:
        return _quantiles_of_many_groups(base, by, probs, exact_distinct_limit)
    spark = df.sparkSession
    key_schema = base.select(*by).schema
    small = [r for r in stats if r["__d"] <= exact_distinct_limit]
    big = [r for r in stats if r["__d"] > exact_distinct_limit]
    out = None
    if small:
        keys = spark.createDataFrame([tuple(r[b] for b in by) for r in small], key_schema)
        out = (base.join(F.broadcast(keys), by, "left_semi").groupBy(*by)
                   .agg(F.percentile("__x", arr).alias("__q"))
                   .select(*by, *[F.col("__q")[i].alias(q) for i, q in enumerate(qcols)]))
    if big:
        exprs, n = {}, {}
        for i, r in enumerate(big):
            cond = F.lit(True)
            for b in by:
                cond = cond & (F.col(b).isNull() if r[b] is None else (F.col(b) == F.lit(r[b])))
            exprs[f"g{i}"] = F.when(cond, x)
            n[f"g{i}"] = r["__n"]
        got = _quantiles_by_selection(df, list(exprs), probs, n, accuracy, collect_limit, exprs=exprs)
        rows = [tuple(r[b] for b in by) + tuple(got[f"g{i}"]) for i, r in enumerate(big)]
        fields = list(key_schema.fields) + [T.StructField(q, T.DoubleType()) for q in qcols]
        extra = spark.createDataFrame(rows, T.StructType(fields))
        out = extra if out is None else out.unionByName(extra)
    if out is None:
        fields = list(key_schema.fields) + [T.StructField(q, T.DoubleType()) for q in qcols]
        out = spark.createDataFrame([], T.StructType(fields))
    return out


def _quantiles_of_many_groups(base: DataFrame, by: list, probs: list, limit: int) -> DataFrame:
    """Exact quantiles for any number of groups, nothing planned per group on
    the driver. Groups of at most ``limit`` rows take one grouped
    ``percentile`` (its map holds no more values than that). Larger ones are
    read off by radix selection: their values as sortable 64-bit integers, a
    table of (group, rank, digits so far), and four passes that count rows per
    group and next 16-bit digit, so that no group is ever in one task."""
    g = [f"__g{i}" for i in range(len(by))]
    base = base.select(*[F.col(b).alias(n) for b, n in zip(by, g)], "__x")
    sizes = base.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"))

    def same(a, b):
        return functools.reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in g])

    small, large = sizes.where(F.col("__n") <= limit), sizes.where(F.col("__n") > limit)
    arr = F.array(*[F.lit(p) for p in probs])
    out = base.join(small, same(base, small), "left_semi").groupBy(*g).agg(F.percentile("__x", arr).alias("__q"))
    out = out.select(*g, *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))])

    rows = cut_lineage(base.join(large, same(base, large), "left_semi").select(*g, _sortable("__x").alias("__v")))
    pos = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("__n") - 1)).alias("at")) for i, p in enumerate(probs)])
    asked = large.select(*g, "__n", F.inline(pos)).withColumn("lo", F.floor("at").cast("long"))
    asked = cut_lineage(asked.withColumns({"hi": F.least(F.col("lo") + 1, F.col("__n") - 1), "part": F.col("at") - F.col("lo")}))
    state = asked.select(*g, F.explode(F.array("lo", "hi")).alias("__k")).distinct().withColumns(
        {"__left": F.col("__k"), "__prefix": F.lit(0).cast("long")})
    for level, shift in enumerate((48, 32, 16, 0)):
        wanted = state.select(*g, "__prefix").distinct()
        # digits so far: the bits above, the sign bit flipped so that they sort as unsigned
        high = F.shiftrightunsigned("__v", shift + 16) if level else F.lit(0).cast("long")
        d = rows.withColumns({"__p": high, "__digit": F.shiftrightunsigned("__v", shift).bitwiseAND(F.lit(0xFFFF))})
        d = d.join(wanted, same(d, wanted) & (d["__p"] == wanted["__prefix"]), "left_semi")
        counts = d.groupBy(*g, "__p", "__digit").agg(F.count(F.lit(1)).alias("__m"))
        w = Window.partitionBy(*g, "__p").orderBy("__digit")          # at most 65,536 rows
        counts = counts.withColumn("__upto", F.sum("__m").over(w))
        hit = state.join(counts, same(state, counts) & (state["__prefix"] == counts["__p"])
                         & (F.col("__upto") > F.col("__left")) & (F.col("__upto") - F.col("__m") <= F.col("__left")))
        state = cut_lineage(hit.select(*[state[n] for n in g], "__k", (F.col("__left") - F.col("__upto") + F.col("__m")).alias("__left"),
                                       (F.col("__prefix") * 65536 + F.col("__digit") if shift else
                                        F.shiftleft("__prefix", 16).bitwiseOR(F.col("__digit"))).alias("__prefix")))
    found = state.select(*g, "__k", _unsortable("__prefix").alias("__y"))
    low, high = found.withColumnRenamed("__k", "lo"), found.withColumnRenamed("__k", "hi").withColumnRenamed("__y", "__z")
    got = asked.join(low, same(asked, low) & (asked["lo"] == low["lo"])).select(*[asked[n] for n in g], "i", asked["hi"], "part", "__y")
    got = got.join(high, same(got, high) & (got["hi"] == high["hi"])).select(
        *[got[n] for n in g], "i", (F.col("__y") + F.col("part") * (F.col("__z") - F.col("__y"))).alias("__q"))
    got = got.groupBy(*g).agg(*[F.max(F.when(F.col("i") == i, F.col("__q"))).alias(f"q{i}") for i in range(len(probs))])
    return out.unionByName(got).select(*[F.col(n).alias(b) for n, b in zip(g, by)], *[f"q{i}" for i in range(len(probs))])


def _sortable(c: str) -> Column:
    """A double's bits as a long that, read as unsigned, sorts as the value
    does (-0 and 0 alike); Spark has no function for the bits."""
    @F.pandas_udf("long")
    def bits(x: pd.Series) -> pd.Series:
        v = (x.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(v < 0, ~v, v ^ np.int64(-1 << 63)))
    return bits(F.col(c))


def _unsortable(c: str) -> Column:
    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.int64)
        return pd.Series(np.where(v < 0, v ^ np.int64(-1 << 63), ~v).view(np.float64))
    return value(F.col(c))


# --------------------------------------------------- exploded value counting
def _exploded_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, lv, dv, sv, cnt) for every non-null value of every column.

    One ``groupBy`` per column, unioned into a single job: each branch reads
    only its own column (column pruning) and is partially aggregated before
    its shuffle, so hot values collapse map-side.
    """
    branches = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        v = F.col(c)
        g = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
        nul = {"lv": F.lit(None).cast("long"), "dv": F.lit(None).cast("double"), "sv": F.lit(None).cast("string")}
        if is_integral_type(dt) or isinstance(dt, T.BooleanType):
            nul["lv"] = F.col("v").cast("long")
        elif is_float_type(dt):
            nul["dv"] = F.col("v").cast("double")
        else:
            nul["sv"] = F.col("v").cast("string")
        branches.append(g.select(F.lit(i).alias("i"), nul["lv"].alias("lv"), nul["dv"].alias("dv"),
                                 nul["sv"].alias("sv"), "cnt"))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionAll(b)
    return out


UNION_CHUNK = 64   # per-column branches per job (keeps plans small on wide tables)


def _chunks(cols: list) -> list:
    return [cols[i:i + UNION_CHUNK] for i in range(0, len(cols), UNION_CHUNK)]


def _decode(df: DataFrame, c: str, lv, dv, sv):
    dt = df.schema[c].dataType
    if isinstance(dt, T.BooleanType):
        return None if lv is None else bool(lv)
    if is_integral_type(dt):
        return lv
    if is_float_type(dt):
        return dv
    return sv


def modes(df: DataFrame, cols: Iterable[str]) -> dict:
    """Most frequent non-null value per column; ties -> smallest value
    (pandas ``mode().iloc[0]``). ``None`` when a column is all null."""
    cols = list(dict.fromkeys(cols))
    out = {c: None for c in cols}
    for part in _chunks(cols):
        best = (_exploded_counts(df, part).groupBy("i")
                .agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "lv", "dv", "sv")).alias("b"))
                .select("i", "b.*").collect())
        for r in best:
            c = part[r["i"]]
            out[c] = _decode(df, c, r["lv"], r["dv"], r["sv"])
    return out


def distinct_counts(df: DataFrame, cols: Iterable[str], cap: int | None = None,
                    profile: dict | None = None) -> dict[str, int]:
    """Distinct non-null values per column.

    With ``cap``, columns whose HyperLogLog estimate is far above it are
    reported with the estimate (they are certainly > cap) and only the rest
    are counted exactly, so continuous columns never go through the exact
    dedup shuffle.
    """
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    out: dict[str, int] = {}
    exact_cols = cols
    if cap is not None:
        got = aggregate(df, {**{c: F.approx_count_distinct(F.col(c)) for c in cols},
                             **{f"n:{c}": F.count(F.col(c)) for c in cols}})
        est = {c: got[c] for c in cols}
        if profile is not None:      # hand the same pass to quantile planning
            profile.update({"distinct": est, "counts": {c: got[f"n:{c}"] for c in cols}})
        exact_cols = [c for c in cols if est[c] <= 2 * cap + 32]
        for c in cols:
            if c not in exact_cols:
                out[c] = int(est[c])
    for c in exact_cols:
        out[c] = 0
    for part in _chunks(exact_cols):
        rows = (_exploded_counts(df, part).groupBy("i")
                .agg(F.count(F.lit(1)).alias("n")).collect())
        for r in rows:
            out[part[r["i"]]] = int(r["n"])
    return out
