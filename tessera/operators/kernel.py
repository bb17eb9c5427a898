"""Support vector machines with an RBF kernel (TRN5, TRN11).

The kernel is approximated by random Fourier features (Rahimi & Recht 2007),
made inside the tasks; on them the primal problems

    1/2 |w|^2 + C * sum of max(0, 1 - y f(x))          (classification)
    1/2 |w|^2 + C * sum of max(0, |y - f(x)| - eps)    (regression)

are solved by Newton's method on losses whose corner is rounded over a width
``mu``, which is halved until the rounding no longer matters. A pass adds up
gradients and curvatures, a second one the loss at several step lengths (with a
single problem also the next gradients, if it is the whole step), so
what the driver gets does not grow with the rows. All problems of a fit (one
per class, each with all rows and without each of five folds) are solved in
the same passes. The folds' decision values calibrate the probabilities
(Platt's sigmoid, per class; several classes are scaled to sum 1).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.plans.passes import fitting, summed

DIM = 128               # random features
FOLDS = 5
HALVINGS = 11           # widths mu: scale, scale / 2, ...
STEPS = np.array([1.0, 0.7, 0.5, 0.35, 0.25, 0.12, 0.06, 0.03, 0.01, 0.0])
SUMS_MB = 64            # gradients and curvatures of one pass; more problems take more passes


# ---------------------------------------------------------------- features
def _features(x: np.ndarray, conf: dict) -> np.ndarray:
    """Random features and a one; missing entries are the column's mean."""
    mean = np.array(conf["mean"])
    x = np.where(np.isnan(x), mean, x) - mean
    rng = np.random.default_rng(conf["seed"])
    w = rng.normal(size=(x.shape[1], conf["dim"])) * np.sqrt(2 * conf["gamma"])
    b = rng.uniform(0, 2 * np.pi, conf["dim"])
    return np.hstack([np.sqrt(2.0 / conf["dim"]) * np.cos(x @ w + b), np.ones((len(x), 1))])


def _describe(data: DataFrame, width: int) -> tuple[list, float]:
    """Column means and gamma = 1 / (columns * variance of all entries)."""
    x = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    got = data.agg(*[F.avg(v) for v in x], *[F.var_pop(v) for v in x]).first()
    mean = [float(v) if v is not None else 0.0 for v in got[:width]]
    var = float(np.mean([v or 0.0 for v in got[width:]]) + np.var(mean)) if width else 0.0
    return mean, 1.0 / (width * var) if var > 0 else 1.0


def _blocks(batches, conf):
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield _features(x, conf), np.asarray(part.column("y")).astype(np.float64), np.asarray(part.column("fold"))


# ------------------------------------------------------------------ losses
def _rounded(a: np.ndarray, mu: float):
    """max(0, a) with its corner rounded over (0, mu): value, slope, inside."""
    inside = (a > 0) & (a < mu)
    return (np.where(inside, a * a / (2 * mu), np.where(a >= mu, a - mu / 2, 0.0)),
            np.where(inside, a / mu, (a >= mu).astype(float)), inside)


def _sides(f, y, problems, eps):
    """For every side of the loss: (a, da/df) by row and problem."""
    if eps is None:
        sign = np.where(y[:, None] == np.array([p[0] for p in problems]), 1.0, -1.0)
        return [(1 - sign * f, -sign)]
    r = f - y[:, None]
    return [(r - eps, 1.0), (-r - eps, -1.0)]


def _kept(fold, problems):
    return fold[:, None] != np.array([p[1] for p in problems])


class _Derivatives:
    """Gradients, curvatures and losses at ``w``, added up over blocks."""

    def __init__(self, w, problems, eps, mu):
        d = w.shape[0]
        self.w, self.problems, self.eps, self.mu = w, problems, eps, mu
        self.grad, self.curve, self.loss = np.zeros_like(w), np.zeros((len(problems), d, d)), np.zeros(len(problems))

    def add(self, z, y, keep):
        for a, slope in _sides(z @ self.w, y, self.problems, self.eps):
            value, first, inside = _rounded(a, self.mu)
            self.loss += (value * keep).sum(0)
            self.grad += z.T @ (first * slope * keep)
            inside &= keep
            for p in range(len(self.problems)):
                band = z[inside[:, p]]
                if len(band):
                    self.curve[p] += band.T @ band / self.mu

    def sums(self):
        return np.concatenate([self.grad.ravel(), self.curve.ravel(), self.loss])


def _derivatives(conf, w, problems, eps, mu):
    def make(batches):
        total = _Derivatives(w, problems, eps, mu)
        for z, y, fold in _blocks(batches, conf):
            total.add(z, y, _kept(fold, problems))
        return total.sums()

    return make, w.size + len(problems) * (w.shape[0] ** 2 + 1)


def _line(conf, w, dw, problems, eps, mu, ahead=None):
    """Losses at all steps, then the derivatives of width ``ahead`` at the whole step."""
    def make(batches):
        total = np.zeros((len(STEPS), len(problems)))
        after = None if ahead is None else _Derivatives(w + dw, problems, eps, ahead)
        for z, y, fold in _blocks(batches, conf):
            keep, f, df = _kept(fold, problems), z @ w, z @ dw
            for i, s in enumerate(STEPS):
                for a, _ in _sides(f + s * df, y, problems, eps):
                    total[i] += (_rounded(a, mu)[0] * keep).sum(0)
            if after is not None:
                after.add(z, y, keep)
        return total.ravel() if after is None else np.concatenate([total.ravel(), after.sums()])

    more = 0 if ahead is None else w.size + len(problems) * (w.shape[0] ** 2 + 1)
    return make, len(STEPS) * len(problems) + more


def solve(data: DataFrame, conf: dict, problems: list, rows: int, cost: float, eps: float | None, scale: float,
          start: float = 0.0) -> np.ndarray:
    """Weights (dim + 1, problems). A problem is (positive class, fold left
    out or -1); ``scale`` is the first width of the rounded corner. Most widths
    take one whole step: with a single problem, whose curvature costs less than
    the features, the pass over step lengths adds up the next derivatives too."""
    d, w = conf["dim"] + 1, np.zeros((conf["dim"] + 1, len(problems)))
    w[-1] = start
    reg = np.ones(d)
    reg[-1] = 0.0
    ridge = np.zeros(d)
    ridge[-1] = 1e-3 * cost * max(rows, 1) / scale
    got, many = None, len(STEPS) * len(problems)
    for half in range(HALVINGS):
        mu = scale / 2 ** half
        ahead = scale / 2 ** (half + 1) if len(problems) == 1 and half + 1 < HALVINGS else None
        for _ in range(8):
            if got is None:
                got = summed(data, *_derivatives(conf, w, problems, eps, mu))
            grad, rest = cost * got[:w.size].reshape(w.shape) + reg[:, None] * w, got[w.size:]
            curve, loss = cost * rest[:-len(problems)].reshape(-1, d, d), rest[-len(problems):]
            dw = np.stack([np.linalg.solve(c + np.diag(reg + ridge) + 1e-9 * np.eye(d), -g)
                           for c, g in zip(curve, grad.T)], 1)
            value = 0.5 * (reg[:, None] * w * w).sum(0) + cost * loss
            line = summed(data, *_line(conf, w, dw, problems, eps, mu, ahead))
            tried = cost * line[:many].reshape(len(STEPS), -1)
            tried += np.stack([0.5 * (reg[:, None] * (w + s * dw) ** 2).sum(0) for s in STEPS])
            best = tried.argmin(0)
            w = w + STEPS[best] * dw
            gain, got = value - tried[best, np.arange(len(problems))], None
            if (gain <= 1e-4 * np.maximum(value, 1e-12)).all():
                if ahead is not None and (best == 0).all():
                    got = line[many:]
                break
    return w


# ------------------------------------------------------------- calibration
def _sigmoids(data, conf, w, problems, classes, counts):
    """Platt's (A, B) per class on the decision values that a row gets from
    the problem trained without its fold."""
    k = len(classes)
    outside = np.array([[problems.index((c, f)) for c in classes] for f in range(FOLDS)])
    total = sum(counts.values())
    pos = np.array([counts.get(c, 0) for c in classes], float)
    high, low = (pos + 1) / (pos + 2), 1 / (total - pos + 2)
    ab = np.stack([np.zeros(k), np.log((total - pos + 1) / (pos + 1))])

    def values(batches):
        for z, y, fold in _blocks(batches, conf):
            f = np.take_along_axis(z @ w, outside[fold], 1)
            yield f, np.where(y[:, None] == np.array(classes), high, low)

    def losses(f, t, ab):
        v = f * ab[0] + ab[1]                       # p = 1 / (1 + exp(v))
        return (t * v + np.logaddexp(0, -v)).sum(0)

    def derivatives(ab):
        def make(batches):
            out = np.zeros((5, k))
            for f, t in values(batches):
                p = 1 / (1 + np.exp(np.clip(f * ab[0] + ab[1], -500, 500)))
                q = p * (1 - p)
                out += np.stack([(f * (t - p)).sum(0), (t - p).sum(0), (f * f * q).sum(0), (f * q).sum(0), q.sum(0)])
            return out.ravel()
        return make

    def tried(ab, step):
        def make(batches):
            out = np.zeros((len(STEPS), k))
            for f, t in values(batches):
                out += np.stack([losses(f, t, ab + s * step) for s in STEPS])
            return out.ravel()
        return make

    for _ in range(20):
        ga, gb, haa, hab, hbb = summed(data, derivatives(ab), 5 * k).reshape(5, k)
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab
        step = -np.stack([(hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det])
        loss = summed(data, tried(ab, step), len(STEPS) * k).reshape(len(STEPS), k)
        best = loss.argmin(0)
        ab = ab + STEPS[best] * step
        if (loss[-1] - loss.min(0) <= 1e-9 * np.maximum(loss[-1], 1e-12)).all():
            break
    return ab


# -------------------------------------------------------------- estimators
def _prepared(df: DataFrame) -> DataFrame:
    x = vector_to_array("features")
    data = df.select(x.alias("x"), F.col("label").cast("double").alias("y"))
    data = data.where("y is not null").withColumn("fold", F.pmod(F.xxhash64("x", "y"), F.lit(FOLDS)).cast("int"))
    return fitting(data, df.count()).persist(StorageLevel.MEMORY_AND_DISK)


class RbfSvc(JsonEstimator):
    """config: classes, C (1), dim, seed."""

    def _fit(self, df: DataFrame) -> "RbfSvcModel":
        c, data = self.conf, _prepared(df)
        counts = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        k = int(c["classes"])
        classes = [1.0] if k == 2 else [float(i) for i in range(k)]
        width = len(data.first()["x"]) if counts else 0
        mean, gamma = _describe(data, width)
        conf = {"mean": mean, "gamma": gamma, "dim": int(c.get("dim", DIM)), "seed": int(c.get("seed", 42))}
        per = max(1, SUMS_MB * (1 << 20) // (8 * (FOLDS + 1) * (conf["dim"] + 2) ** 2))
        weights, ab = [], []
        for at in range(0, len(classes), per):
            own = classes[at:at + per]
            problems = [(v, f) for v in own for f in range(-1, FOLDS)]
            w = solve(data, conf, problems, sum(counts.values()), float(c.get("C", 1.0)), None, 2.0)
            ab.append(_sigmoids(data, conf, w, problems, own, counts))
            weights.append(w[:, [problems.index((v, -1)) for v in own]])
        data.unpersist()
        state = {**conf, "w": np.hstack(weights).tolist(), "ab": np.hstack(ab).tolist()}
        return RbfSvcModel(config=c, state=state)


class RbfSvcModel(JsonStateModel):
    """Adds probability (vector, calibrated) and prediction (by the decision
    values; the first class in a tie)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.state)

        def score(parts):
            s = json.loads(text)
            w, ab = np.array(s["w"]), np.array(s["ab"])
            for x in parts:
                f = _features(np.stack(x), s) @ w if len(x) else np.zeros((0, w.shape[1]))
                p = 1 / (1 + np.exp(np.clip(f * ab[0] + ab[1], -500, 500)))
                if w.shape[1] == 1:
                    p, best = np.hstack([1 - p, p]), (f[:, 0] > 0).astype(float)
                else:
                    p, best = p / np.maximum(p.sum(1, keepdims=True), 1e-300), f.argmax(1).astype(float)
                yield pd.Series(list(np.hstack([p, best[:, None]])))

        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        got = df.withColumn("__s", F.pandas_udf(score, "array<double>")(vector_to_array("features")))
        n = F.size("__s")
        return got.withColumns({"probability": array_to_vector(F.slice("__s", 1, n - 1)),
                                "prediction": F.element_at("__s", n)}).drop("__s")


class RbfSvr(JsonEstimator):
    """config: C (1), epsilon (0.1), dim, seed."""

    def _fit(self, df: DataFrame) -> "RbfSvrModel":
        c, data = self.conf, _prepared(df)
        n, level, spread = data.agg(F.count("y"), F.avg("y"), F.stddev_pop("y")).first()
        width = len(data.first()["x"]) if n else 0
        mean, gamma = _describe(data, width)
        conf = {"mean": mean, "gamma": gamma, "dim": int(c.get("dim", DIM)), "seed": int(c.get("seed", 42))}
        w = np.zeros((conf["dim"] + 1, 1))
        if n:
            w = solve(data, conf, [(0.0, -1)], n, float(c.get("C", 1.0)), float(c.get("epsilon", 0.1)),
                      2 * (spread or 0.0) or 1.0, level)
        data.unpersist()
        return RbfSvrModel(config=c, state={**conf, "w": w[:, 0].tolist()})


class RbfSvrModel(JsonStateModel):
    """Adds prediction."""

    def _transform(self, df: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.state)

        def score(parts):
            s = json.loads(text)
            for x in parts:
                yield pd.Series(_features(np.stack(x), s) @ np.array(s["w"]) if len(x) else np.zeros(0))

        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn("prediction", F.pandas_udf(score, "double")(vector_to_array("features")))
