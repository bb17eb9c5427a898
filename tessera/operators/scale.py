"""Scaling (SCL1-SCL7). Parameters come from one aggregate pass (exact
quantiles for robust); the transform is one projection with literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_list, is_numeric_type
from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.plans.stats import aggregate, quantiles

SCALERS = ("standard", "minmax", "robust")


def scaler_params(df: DataFrame, cols, method: str = "standard") -> dict:
    """col -> [center, scale]; a zero scale becomes 1 (so x - center)."""
    cols = as_list(cols)
    if method not in SCALERS:
        raise ValueError(f"unknown scaler {method!r}")
    x = {c: F.col(c).cast("double") for c in cols}
    out = {}
    if method == "standard":
        st = aggregate(df, {**{f"m:{c}": F.avg(x[c]) for c in cols},
                            **{f"s:{c}": F.stddev_pop(x[c]) for c in cols}})
        for c in cols:
            s = st[f"s:{c}"]
            out[c] = [st[f"m:{c}"], s if s else 1.0]
    elif method == "minmax":
        st = aggregate(df, {**{f"lo:{c}": F.min(x[c]) for c in cols},
                            **{f"hi:{c}": F.max(x[c]) for c in cols}})
        for c in cols:
            lo, hi = st[f"lo:{c}"], st[f"hi:{c}"]
            rng = (hi - lo) if (lo is not None and hi is not None) else None
            out[c] = [lo, rng if rng else 1.0]
    else:
        q = quantiles(df, cols, [0.25, 0.5, 0.75])
        for c in cols:
            q1, med, q3 = q[c]
            iqr = (q3 - q1) if q1 is not None else None
            out[c] = [med, iqr if iqr else 1.0]
    return out


def apply_scaling(df: DataFrame, params: dict) -> DataFrame:
    out = []
    for c in df.columns:
        if c in params and params[c][0] is not None:
            center, scale = params[c]
            out.append(((F.col(c).cast("double") - F.lit(center)) / F.lit(scale)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def scale(df: DataFrame, cols, method: str = "standard") -> DataFrame:
    """SCL1-SCL3: standard (population std), min-max, robust."""
    return apply_scaling(df, scaler_params(df, cols, method))


class Scaler(JsonEstimator):
    """SCL6: fit once, apply to new data, save / load. ``config`` =
    {"columns": [...], "method": "standard"}; default columns = numeric
    except ``target``."""

    def _fit(self, df: DataFrame) -> "ScalerModel":
        cfg = self.conf
        cols = cfg.get("columns") or [f.name for f in df.schema.fields
                                      if is_numeric_type(f.dataType) and f.name != cfg.get("target")]
        return ScalerModel(config=cfg, state={"params": scaler_params(df, cols, cfg.get("method", "standard"))})


class ScalerModel(JsonStateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return apply_scaling(df, self.fitted["params"])


def scale_selected(df: DataFrame, features, target: str, method: str = "standard"):
    """SCL4: scale the numeric selected features, pass text features through,
    re-attach the target last. Returns ``(scaled_df, info_df)``."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    feats = [c for c in as_list(features) if c != target]
    if not feats:
        raise ValueError("no feature columns (after excluding the target)")
    missing = [c for c in feats if c not in df.columns]
    if missing:
        raise ValueError(f"selected features not found: {missing}")
    numeric = [c for c in feats if is_numeric_type(df.schema[c].dataType)]
    other = [c for c in feats if c not in numeric]
    out = apply_scaling(df.select(*feats, target), scaler_params(df, numeric, method))
    n = df.count()
    info = df.sparkSession.createDataFrame(
        [(method, target, len(feats), len(numeric), len(other), n,
          ",".join(numeric), ",".join(other))],
        "method string, target_column string, n_features int, n_scaled int, n_skipped int, "
        "n_samples long, numeric_features_scaled string, non_numeric_features_skipped string")
    return out, info


def recommend_scaler(df: DataFrame, features, target: str) -> str:
    """SCL5: 'robust' when more than 30 % of the numeric features have more
    than 5 % IQR outliers (share of all rows), else 'standard'."""
    feats = [c for c in as_list(features) if c != target and c in df.columns
             and is_numeric_type(df.schema[c].dataType)]
    if not feats:
        return "standard"
    q = quantiles(df, feats, [0.25, 0.75])
    exprs = {"__n": F.count(F.lit(1))}
    for c in feats:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        x = F.col(c).cast("double")
        exprs[c] = F.count_if((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr)))
    st = aggregate(df, exprs)
    n = st["__n"]
    flagged = sum(1 for c in feats if c in st and n and st[c] / n > 0.05)
    return "robust" if flagged / len(feats) > 0.3 else "standard"


def scale_and_split(df: DataFrame, features, target: str, keys, method: str = "standard",
                    test_fraction: float = 0.2, leaky: bool = False):
    """SCL7: split by key hash, fit the scaler on the training side only
    (``leaky=True`` reproduces the reference: fit on all rows first)."""
    from tessera.operators.split import split
    feats = [c for c in as_list(features) if c != target]
    numeric = [c for c in feats if is_numeric_type(df.schema[c].dataType)]
    keys = as_list(keys)
    base = df.select(*dict.fromkeys(keys + feats + [target]))
    train, test = split(base, keys, test_fraction)
    params = scaler_params(base if leaky else train, numeric, method)
    return apply_scaling(train, params), apply_scaling(test, params)


def load_latest_scaler(spark, folder: str) -> ScalerModel:
    """SCL6 reload: the most recently saved scaler under ``folder`` (by
    modification time, as the reference picks its latest scaler file)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = [s for s in fs.listStatus(path) if s.isDirectory()]
    if not entries:
        raise FileNotFoundError(f"no saved scaler under {folder}")
    latest = max(entries, key=lambda s: s.getModificationTime())
    return ScalerModel.load(latest.getPath().toString())
