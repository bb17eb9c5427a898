"""Imputation (IMP1-IMP10).

All fill values come from at most three bounded passes (means in one
``agg``, exact medians through the quantile planner, modes through one
exploded count); the fill itself is one ``select`` of ``coalesce``s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import is_numeric_type
from tessera.operators.clean import UNKNOWN, apply_fills
from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.operators.neighbours import impute_knn  # noqa: F401 - IMP5, multi-column mode
from tessera.operators.profile import missing_profile_rows
from tessera.plans.stats import aggregate, modes, quantiles, stats_input

METHODS = ("mean", "median", "most_frequent", "constant", "knn", "iterative")
MEAN_LIKE = ("mean", "knn", "iterative")   # knn / iterative on one column = mean


def recommend_imputation(df: DataFrame, rule: str = "analysis") -> dict[str, str]:
    """Method per column with NULLs: PRF2 tiers (``analysis``) or the
    fitted pipeline's own rule (IMP10, ``pipeline``)."""
    return {r["column_name"]: r["recommended"] for r in missing_profile_rows(df, rule=rule)}


def imputation_fills(df: DataFrame, config: dict | None = None, constants: dict | None = None,
                     rule: str = "analysis") -> dict:
    """Resolve a fill value for every column that has NULLs (IMP8)."""
    with stats_input(df) as s:
        return _imputation_fills(s, config, constants, rule)


def _imputation_fills(df, config, constants, rule):
    config = dict(config or {})
    constants = dict(constants or {})
    numeric = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    # pass 1: NULL counts, means and distinct estimates of every column at once
    st = aggregate(df, {"__n": F.count(F.lit(1)),
                        **{f"m:{c}": F.count_if(F.col(c).isNull()) for c in df.columns},
                        **{f"a:{c}": F.avg(F.col(c).cast("double")) for c in numeric},
                        **{f"d:{c}": F.approx_count_distinct(F.col(c).cast("double")) for c in numeric}})
    n = st["__n"]
    need = [c for c in df.columns if st[f"m:{c}"] > 0]
    missing_cfg = [c for c in need if not config.get(c)]
    if missing_cfg:
        rec = {r["column_name"]: r["recommended"]
               for r in missing_profile_rows(df, missing_cfg, rule=rule)}
        config.update(rec)
    plan = {}
    for c in need:
        is_num = is_numeric_type(df.schema[c].dataType)
        m = config[c]
        if m not in METHODS:
            m = "mean" if is_num else "most_frequent"       # IMP7 fallback
        if not is_num and m in MEAN_LIKE + ("median",):
            m = "most_frequent"
        plan[c] = m
    medians = [c for c in need if plan[c] == "median"]
    mode_cols = [c for c in need if plan[c] == "most_frequent"]
    med = quantiles(df, medians, [0.5], counts={c: n - st[f"m:{c}"] for c in medians},
                    distinct={c: st[f"d:{c}"] for c in medians}) if medians else {}
    md = modes(df, mode_cols)
    fills = {}
    for c in need:
        is_num = is_numeric_type(df.schema[c].dataType)
        m = plan[c]
        if m in MEAN_LIKE:
            fills[c] = st[f"a:{c}"]
        elif m == "median":
            fills[c] = med[c][0]
        elif m == "most_frequent":
            fills[c] = md[c] if md[c] is not None else (0 if is_num else UNKNOWN)
        else:  # constant
            fills[c] = constants.get(c, 0 if is_num else UNKNOWN)
    return {"methods": plan, "fills": fills}


def impute(df: DataFrame, config: dict | None = None, constants: dict | None = None,
           rule: str = "analysis") -> DataFrame:
    """IMP1-IMP8: fill each column by its configured (or recommended) method."""
    return apply_fills(df, imputation_fills(df, config, constants, rule)["fills"])


class Imputer(JsonEstimator):
    """IMP9: learn fills on training data, replay them on new data (batch or
    stream) without refitting. ``config`` = {"columns": {...}, "constants":
    {...}, "rule": "pipeline"|"analysis", "exclude": [...]}."""

    def _fit(self, df: DataFrame) -> "ImputerModel":
        cfg = self.conf
        cols = [c for c in df.columns if c not in set(cfg.get("exclude", []))]
        res = imputation_fills(df.select(*cols), cfg.get("columns"), cfg.get("constants"),
                               cfg.get("rule", "pipeline"))
        return ImputerModel(config=cfg, state=res)


class ImputerModel(JsonStateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        fills = {c: v for c, v in self.fitted["fills"].items() if c in df.columns}
        return apply_fills(df, fills)


def impute_iterative(df: DataFrame, cols, features=None, max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """IMP6, multi-column mode (the reference's stated intent; its one-column
    call reduces to the mean, which ``impute`` keeps as parity mode).

    Round-robin regression: start from column means, then for each column
    with NULLs fit a Spark ML ``LinearRegression`` on the rows where it is
    observed, using the other (currently filled) columns, and replace only
    the originally missing cells with the predictions. Repeats until the
    largest change of a filled mean is below ``tol`` or ``max_iter`` rounds.
    The driver loop is bounded by rounds x columns; every fit is distributed,
    and the working table is checkpointed each round to keep lineage short.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tessera.session import cut_lineage
    cols = list(cols)
    feats = list(features) if features is not None else [
        c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    means = aggregate(df, {c: F.avg(F.col(c).cast("double")) for c in set(cols) | set(feats)})
    work = df.select("*", *[F.col(c).isNull().alias(f"__miss_{c}") for c in cols])
    work = work.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c)
                         if c in set(cols) | set(feats) else F.col(c) for c in work.columns])
    work = cut_lineage(work)
    prev = {c: means[c] for c in cols}
    for _ in range(max_iter):
        for c in cols:
            others = [f for f in feats if f != c]
            if not others:
                continue
            va = VectorAssembler(inputCols=others, outputCol="__x", handleInvalid="keep")
            observed = va.transform(work.where(~F.col(f"__miss_{c}")))
            model = LinearRegression(featuresCol="__x", labelCol=c, predictionCol="__p").fit(observed)
            scored = model.transform(va.transform(work))
            work = scored.select(*[F.when(F.col(f"__miss_{c}"), F.col("__p")).otherwise(F.col(c)).alias(c)
                                   if x == c else F.col(x) for x in work.columns])
        work = cut_lineage(work)
        cur = aggregate(work, {c: F.avg(F.when(F.col(f"__miss_{c}"), F.col(c))) for c in cols})
        delta = max((abs((cur[c] or 0.0) - (prev[c] or 0.0)) for c in cols), default=0.0)
        prev = cur
        if delta < tol:
            break
    return work.select(*df.columns)
