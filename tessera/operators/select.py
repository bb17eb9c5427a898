"""Feature selection by formula (SEL2-SEL5, SEL12-SEL16).

Every score is one aggregate pass: Pearson r per feature with the target
(zero-variance guarded), or per-class count / mean / variance for the
ANOVA F (one ``groupBy(target)``: as many rows as classes).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_list, is_numeric_type, normalized_name
from tessera.functions.exprs import guarded_corr
from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.plans.stats import aggregate, distinct_counts
from tessera.session import cut_lineage

# Identifier-name rule (regexes on the lower-cased name, and
# exact names) used to drop key-like columns before correlation ranking.
IDENTIFIER_PATTERNS = [r".*_?id$", r"^id_?", r".*_no$", r"^no_?"]
KNOWN_IDENTIFIERS = [
    "loan_id", "customer_id", "user_id", "application_id",
    "id", "loan_number", "account_number", "serial",
    "index", "idx", "record_id", "case_id",
]


def is_identifier(name: str) -> bool:
    low = name.lower()
    return any(re.search(p, low) for p in IDENTIFIER_PATTERNS) or low in KNOWN_IDENTIFIERS


SCORE_SCHEMA = "feature string, score double"


def _corrs(df: DataFrame, target: str, feats: list) -> dict:
    return aggregate(df, {c: guarded_corr(c, target) for c in feats}) if feats else {}


def correlation_importance(df: DataFrame, target: str, cols=None):
    """SEL2: |r| with the target scaled so the best feature scores 100
    (2 dp); identifier-named columns removed; NULL r dropped. Returns
    ``(scores_df, removed_identifiers)``."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    if not is_numeric_type(df.schema[target].dataType):
        raise ValueError(f"target {target!r} must be numeric for correlation")
    if cols is None:
        cols = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name != target]
    removed = [c for c in cols if is_identifier(c)]
    valid = [c for c in cols if c not in removed and c in df.columns
             and is_numeric_type(df.schema[c].dataType)]
    r = {c: v for c, v in _corrs(df, target, valid).items() if v is not None and not math.isnan(v)}
    top = max((abs(v) for v in r.values()), default=1.0) or 1.0
    rows = [(c, float(v), abs(v), round(abs(v) / top * 100, 2)) for c, v in r.items()]
    rows.sort(key=lambda t: (-t[3], t[0]))
    out = df.sparkSession.createDataFrame(
        rows, "feature string, correlation double, abs_correlation double, importance double")
    return out, removed


def _encoded(df: DataFrame, target: str) -> DataFrame:
    from tessera.operators.encode import encode_all_ordinal
    enc, _ = encode_all_ordinal(df, target)
    return enc


def correlation_with_target(df: DataFrame, target: str) -> DataFrame:
    """SEL3: |r| of every (ordinal-encoded) feature with the target."""
    if not is_numeric_type(df.schema[target].dataType):
        raise ValueError(f"correlation needs a numeric target; {target!r} is not")
    enc = _encoded(df, target)
    feats = [f.name for f in enc.schema.fields if f.name != target and is_numeric_type(f.dataType)]
    r = _corrs(enc, target, feats)
    rows = [(c, abs(r[c]) if r[c] is not None else None) for c in feats]
    return df.sparkSession.createDataFrame(rows, SCORE_SCHEMA)


def _numeric_target(enc: DataFrame, target: str) -> DataFrame:
    if is_numeric_type(enc.schema[target].dataType):
        return enc
    from tessera.operators.encode import encode_target
    out, _ = encode_target(enc, target)
    return out


def anova_f(df: DataFrame, target: str, feats: list) -> dict:
    """One-way ANOVA F of each feature across target classes (f_classif):
    F = (SSB / (k-1)) / (SSW / (n-k)) from per-class n, mean, var_pop. The
    classes stay a table of any length; two one-row sums over it reach the driver."""
    x = {c: F.col(c).cast("double") for c in feats}
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("__n"),
                               *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(feats)],
                               *[F.var_pop(x[c]).alias(f"v{i}") for i, c in enumerate(feats)])
    g = cut_lineage(g)
    w = F.col("__n")
    st = aggregate(g, {"n": F.sum(w), "k": F.count(F.lit(1)), **{f"g{i}": F.sum(w * F.col(f"m{i}")) for i in range(len(feats))}})
    n, k = st["n"] or 0, st["k"]
    grand = [(st[f"g{i}"] or 0.0) / n if n else 0.0 for i in range(len(feats))]
    sums = aggregate(g, {**{f"b{i}": F.sum(w * (F.col(f"m{i}") - F.lit(grand[i])) ** 2) for i in range(len(feats))},
                         **{f"w{i}": F.sum(w * F.col(f"v{i}")) for i in range(len(feats))}}) if feats else {}
    out = {}
    for i, c in enumerate(feats):
        ssb, ssw = sums[f"b{i}"] or 0.0, sums[f"w{i}"] or 0.0
        if k < 2 or n - k <= 0:
            out[c] = None
        elif ssw == 0:
            out[c] = math.inf if ssb > 0 else None
        else:
            out[c] = (ssb / (k - 1)) / (ssw / (n - k))
    return out


def f_regression(df: DataFrame, target: str, feats: list) -> dict:
    """F = r^2 / (1 - r^2) * (n - 2) with centred Pearson r."""
    st = aggregate(df, {"__n": F.count(F.lit(1)), **{c: guarded_corr(c, target) for c in feats}})
    n = st["__n"]
    out = {}
    for c in feats:
        r = st[c]
        if r is None:
            out[c] = None
        elif abs(r) >= 1:
            out[c] = math.inf
        else:
            out[c] = r * r / (1 - r * r) * (n - 2)
    return out


def kbest(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    """SEL4 / SEL5: F score per encoded feature (ANOVA when the target has
    <= 10 distinct values, else regression F); ``selected`` = top k by score
    (name breaks ties)."""
    enc = _numeric_target(_encoded(df, target), target)
    feats = [c for c in enc.columns if c != target]
    nun = distinct_counts(enc, [target], cap=10)[target]
    scores = anova_f(enc, target, feats) if nun <= 10 else f_regression(enc, target, feats)
    return _ranked(df.sparkSession, scores, min(k, len(feats)))


def _ranked(spark, scores: dict, k: int, by_abs: bool = False) -> DataFrame:
    def key(item):
        c, s = item
        v = -math.inf if s is None or (isinstance(s, float) and math.isnan(s)) else (abs(s) if by_abs else s)
        return (-v, c)
    order = sorted(scores.items(), key=key)
    rows = [(c, None if s is None else float(s), i + 1, i < k) for i, (c, s) in enumerate(order)]
    return spark.createDataFrame(rows, "feature string, score double, rank int, selected boolean")


def select_features(df: DataFrame, target: str, method: str, k: int = 5) -> DataFrame:
    """SEL12: dispatcher -> (feature, score, rank, selected). ``none`` keeps
    every feature with score 0; model-based methods live in ``train``."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found; columns: {df.columns}")
    spark = df.sparkSession
    if method == "correlation":
        sc = {r["feature"]: r["score"] for r in correlation_with_target(df, target).collect()}
        return _ranked(spark, sc, k, by_abs=True)
    if method == "kbest":
        return kbest(df, target, k)
    if method in ("rfe", "tree"):
        from tessera.operators import train as TR
        return TR.rfe(df, target, k) if method == "rfe" else TR.tree_importance(df, target, k)
    if method == "none":
        feats = [c for c in df.columns if c != target]
        rows = [(c, 0.0, i + 1, True) for i, c in enumerate(feats)]
        return spark.createDataFrame(rows, "feature string, score double, rank int, selected boolean")
    raise ValueError(f"unknown feature selection method {method!r}")


def irrelevant_features(df: DataFrame, target: str, threshold: float = 0.05) -> DataFrame:
    """SEL13: numeric columns with <= 1 distinct value or |r| < threshold."""
    if not is_numeric_type(df.schema[target].dataType):
        raise ValueError(f"irrelevant-feature check needs a numeric target; {target!r} is not")
    num = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name != target]
    nun = distinct_counts(df, num, cap=1)
    r = _corrs(df, target, num)
    rows = []
    for c in num:
        const = nun[c] <= 1
        low = r[c] is not None and abs(r[c]) < threshold
        if const or low:
            rows.append((c, "constant" if const else "low_correlation",
                         None if r[c] is None else abs(r[c])))
    return df.sparkSession.createDataFrame(rows, "feature string, reason string, abs_correlation double")


def project_features(df: DataFrame, names, target: str | None = None) -> DataFrame:
    """SEL14: keep the named features (exact name, else lower-case with
    spaces as underscores), then the target."""
    keep = []
    for n in as_list(names):
        if n in df.columns:
            keep.append(n)
            continue
        want = normalized_name(n)
        for c in df.columns:
            if normalized_name(c) == want:
                keep.append(c)
                break
    if target and target not in keep:
        keep.append(target)
    if not keep:
        raise ValueError("no valid features found")
    return df.select(*dict.fromkeys(keep))


def top_correlated(df: DataFrame, target: str, k: int = 10, max_columns: int | None = None) -> list:
    """SEL15: names of the top-k numeric features by |r| (ties by name).
    With ``max_columns`` (AutoML: 50), tables with fewer than 2 or more
    than that many numeric features keep them all."""
    num = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name != target]
    if max_columns is not None and not (2 <= len(num) <= max_columns):
        return num
    r = _corrs(df, target, num)
    order = sorted(num, key=lambda c: (-(abs(r[c]) if r[c] is not None else -1.0), c))
    return order[:k]


class Selector(JsonEstimator):
    """SEL16: remember the selected names at fit time and replay the
    projection. ``config`` = {"target", "k", "method": "correlation"}."""

    def _fit(self, df: DataFrame) -> "SelectorModel":
        cfg = self.conf
        target = cfg["target"]
        if cfg.get("features"):
            names = list(cfg["features"])
        else:
            names = top_correlated(df, target, int(cfg.get("k", 10)))
        return SelectorModel(config=cfg, state={"features": names})


class SelectorModel(JsonStateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        target = self.conf.get("target")
        keep = [c for c in self.fitted["features"] if c in df.columns]
        if target and target in df.columns:
            keep.append(target)
        return df.select(*keep)
