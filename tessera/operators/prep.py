"""Fitted preprocessing (PIP1-PIP3): impute -> encode -> select -> scale,
learned once and replayed on new batches or streams without refitting.

Each step's state is small (fill literals, code maps or code-table paths,
selected names, scaler constants), so the fitted model's ``transform`` is a
single chain of projections (plus joins for huge code tables): map-only,
no shuffle, valid on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.functions.columns import is_numeric_type
from tessera.operators import select as SEL
from tessera.operators.clean import apply_fills
from tessera.operators.encode import Encoder, _apply as apply_encoding
from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.operators.impute import imputation_fills
from tessera.operators.profile import task_type_of
from tessera.operators.scale import apply_scaling, scaler_params
from tessera.plans.stats import stats_input


def _imputation_config(cfg: dict):
    methods, constants = {}, {}
    for c, v in (cfg or {}).items():
        if isinstance(v, str):
            methods[c] = v
            if v == "constant":
                constants[c] = 0
        else:
            methods[c] = v.get("method")
            if v.get("fill_value") is not None:
                constants[c] = v["fill_value"]
            elif methods[c] == "constant":
                constants[c] = 0
    return {c: m for c, m in methods.items() if m}, constants


class Preprocessor(JsonEstimator):
    """PIP1. ``config`` = {"target": str, "imputation": {col: method |
    {"method", "fill_value"}}, "encoding": {col: method}, "scaling":
    "standard", "selection": {"method": "none", "k": 10}, "task_type":
    None (auto)}."""

    def _fit(self, df: DataFrame) -> "PreprocessorModel":
        with stats_input(df) as d:        # many passes: run an upstream shuffle once
            return self._fit_passes(d)

    def _fit_passes(self, df: DataFrame) -> "PreprocessorModel":
        cfg = self.conf
        target = cfg["target"]
        if target not in df.columns:
            raise ValueError(f"target column {target!r} not found")
        task = cfg.get("task_type") or task_type_of(df, target)[0]
        feats = [c for c in df.columns if c != target]
        methods, constants = _imputation_config(cfg.get("imputation"))
        imp = imputation_fills(df.select(*feats), methods, constants, rule="pipeline")
        d1 = apply_fills(df, imp["fills"])
        enc_cfg = {c: (v if isinstance(v, str) else v.get("method")) for c, v in (cfg.get("encoding") or {}).items()}
        enc = Encoder({"target": target, "columns": enc_cfg, "rule": "pipeline"}).fit(d1)
        d2 = enc.transform(d1)
        features = self._select(d2, target, task, cfg.get("selection") or {})
        d3 = d2.select(*features, target)
        scaling = cfg.get("scaling", "standard")
        num = [c for c in features if is_numeric_type(d3.schema[c].dataType)]
        params = scaler_params(d3, num, scaling) if scaling != "none" and num else {}
        state = {"fills": imp["fills"], "encoder": enc.fitted, "features": features,
                 "scaler": params, "task_type": task}
        return PreprocessorModel(config=cfg, state=state)

    @staticmethod
    def _select(d: DataFrame, target: str, task: str, sel: dict) -> list:
        method = sel.get("method", "none")
        feats = [c for c in d.columns if c != target]
        k = min(int(sel.get("k", 10)), len(feats))
        if method == "none" or k <= 0 or len(feats) <= k:
            return feats
        num = [c for c in feats if is_numeric_type(d.schema[c].dataType)]
        if not num:
            return feats
        x = d.select(*num, target)
        if method == "correlation":
            return SEL.top_correlated(x, target, k)
        if method == "kbest":
            scores = SEL.anova_f(x, target, num) if task == "classification" else SEL.f_regression(x, target, num)
            ranked = SEL._ranked(d.sparkSession, scores, k).where("selected").collect()
            chosen = {r["feature"] for r in ranked}
            return [c for c in num if c in chosen]
        if method in ("rfe", "tree"):
            from tessera.operators import train as TR
            est = "logistic" if (method == "rfe" and task == "classification") else "forest"
            r = (TR.rfe(x, target, k, est=est, n_trees=50) if method == "rfe"
                 else TR.forest_rank(x, target, k)).where("selected").collect()
            chosen = {row["feature"] for row in r}
            return [c for c in num if c in chosen]
        raise ValueError(f"unknown selection method {method!r}")

    def fit_transform(self, df: DataFrame):
        """Fit and transform the training table; the target is kept, last."""
        model = self.fit(df)
        return model, model.transform_keep_target(df)


class PreprocessorModel(JsonStateModel):
    """PIP2 / PIP3: replay on new data (target dropped if present); save /
    load through Spark ML's params writer."""

    def transform_keep_target(self, df: DataFrame, keep=()) -> DataFrame:
        """``keep``: columns, such as keys, that go through unchanged."""
        st = self.fitted
        target = self.conf["target"]
        d = apply_fills(df, {c: v for c, v in st["fills"].items() if c in df.columns})
        d = apply_encoding(d, {c: v for c, v in st["encoder"].items() if c in d.columns})
        chosen = [c for c in st["features"] if c in d.columns]
        d = d.select(*keep, *chosen, *([target] if target in d.columns else []))
        return apply_scaling(d, st["scaler"])

    def _transform(self, df: DataFrame) -> DataFrame:
        target = self.conf["target"]
        out = self.transform_keep_target(df)
        return out.drop(target) if target in out.columns else out

    @property
    def feature_columns(self) -> list:
        return list(self.fitted["features"])
