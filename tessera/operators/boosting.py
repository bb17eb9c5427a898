"""Gradient boosting for any number of classes (TRN7) and for numbers (TRN10).

Each round grows one regression tree per class on the gradients of the
multinomial log-loss (for two classes this is logistic boosting: the two trees
mirror each other), or one tree on the residuals. All trees of a round grow together: the features are
binned once, every level is one pass in which tasks add up histograms of
(rows, gradient, curvature) per class, node, column and bin, and only their sum
reaches the driver, a table whose size does not depend on the rows. Leaf values
are Newton steps read off the last histograms. A row of the staged table is a
block of up to an Arrow batch of rows, so that a pass hands arrays to its
tasks, not rows.

The scores of the rows are part of a staged table that is written anew every
``REFRESH`` rounds; passes in between apply the few trees since then, so no
lineage grows with the rounds and a lost executor only repeats its part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.plans.passes import fitting, summed
from tessera.session import ensure_checkpoint_dir

BINS = 64                   # per column, bin 0 for missing values
REFRESH = 10                # rounds between staged score tables
TABLE_MB = 64               # histogram table of one pass; more classes take more passes
TABLE_BITS = 8              # inner nodes of a tree that is looked up in a table; more are walked level by level


# ------------------------------------------------------------------ passes
def _stage(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/boosting/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).persist(StorageLevel.MEMORY_AND_DISK)


def _rows(batch, width: int, classes: int):
    """(bins, label, scores) of each block of a batch of the staged table, a
    block's arrays being one binary each; ``classes`` 0 has one column of
    scores. Bins lie column by column, as trees and histograms read them."""
    for bins, label, scores in zip(*(batch.column(c) for c in ("bins", "label", "scores"))):
        y = np.frombuffer(label.as_buffer())
        yield (np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, len(y)).T, y,
               np.frombuffer(scores.as_buffer()).reshape(len(y), max(classes, 1)).copy())


# ------------------------------------------------------------------- trees
def _walk(tree, bins: np.ndarray) -> np.ndarray:
    """Node of each row. A tree is arrays (column, bin, left, right, value);
    rows whose bin is at most the node's go left; column -1 is a leaf. A small
    tree is a table by the answers of all its inner nodes, one bit each."""
    col, cut, left, right, _ = tree
    inner = np.flatnonzero(col >= 0)
    if 0 < len(inner) <= TABLE_BITS:
        answers = np.arange(1 << len(inner), dtype=np.uint16)
        goal = np.zeros(len(answers), np.int64)
        code = np.zeros(len(bins), np.uint16)
        for i, n in enumerate(inner):     # parents come before their children
            goal = np.where(goal == n, np.where(answers >> i & 1, right[n], left[n]), goal)
            code |= (bins[:, col[n]] > cut[n]).astype(np.uint16) << np.uint16(i)
        return np.take(goal, code)
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins)) if col[0] >= 0 else np.zeros(0, np.int64)
    while len(live):
        n = at[live]
        at[live] = np.where(bins[live, col[n]] <= cut[n], left[n], right[n])
        live = live[col[at[live]] >= 0]
    return at


def _add_trees(scores: np.ndarray, bins: np.ndarray, rounds) -> np.ndarray:
    for trees in rounds:
        for k, t in enumerate(trees):
            scores[:, k] += t[4][_walk(t, bins)]
    return scores


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _histograms(width, classes, recent, trees, open_at, group):
    """Per task: (3, classes of the group, open nodes, columns, bins) of
    rows, gradient and curvature."""
    nodes = max(len(o) for o in open_at)

    def make(batches):
        total = None
        for bins, y, s in (block for b in batches for block in _rows(b, width, classes)):
            s = _add_trees(s, bins, recent)
            p = _softmax(s) if classes else s
            place = np.full((len(y), len(group)), -1, np.int64)
            r = np.empty(place.shape)
            for i, k in enumerate(group):
                if len(open_at[i]):
                    slot = np.full(len(trees[i][0]), -1, np.int64)
                    slot[open_at[i]] = np.arange(len(open_at[i]))
                    place[:, i] = slot[_walk(trees[i], bins)]
                r[:, i] = (y == k) - p[:, k] if classes else y - p[:, 0]
            row, col = np.nonzero(place >= 0)
            base = (col * nodes + place[row, col]) * BINS
            g = r[row, col]
            h = np.abs(g) * (1 - np.abs(g))     # read with classes only; for numbers each row counts 1
            cells = len(group) * nodes * BINS
            if total is None:
                total = np.zeros((3, width, cells))
            for f in range(width):
                at = base + np.take(bins[:, f], row)
                n = np.bincount(at, minlength=cells)
                total[0, f] += n
                total[1, f] += np.bincount(at, g, cells)
                total[2, f] += np.bincount(at, h, cells) if classes else n
        return None if total is None else total.ravel()

    return make, (3, width, len(group), nodes, BINS)


def _best(hist: np.ndarray):
    """hist (3, columns, bins) of one node: (gain, column, bin, left sums,
    right sums) of the split that parts the gradients most, None without one.
    Ties go to the first column and bin."""
    left = hist.cumsum(2)
    whole = left[:, :, -1:]
    right = whole - left
    n, m = left[0], right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((n > 0) & (m > 0), (left[1] / n - right[1] / m) ** 2 * n * m / (n + m), -1.0)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[f, b] > 1e-12 * max(1.0, whole[0, 0, 0]):
        return None
    return float(gain[f, b]), int(f), int(b), left[:, f, b], right[:, f, b]


def grow(table: DataFrame, width: int, classes: int, rounds: int, depth: int, rate: float):
    """(trees by round and class, gain by column); ``classes`` 0: one tree a
    round on the residuals."""
    done, recent, importance = [], [], np.zeros(width)
    columns = max(classes, 1)
    step = rate * (classes - 1) / classes if classes else rate

    def value(sums):
        return step * sums[1] / sums[2] if abs(sums[2]) > 1e-150 else 0.0

    for t in range(rounds):
        trees = [[[-1], [0], [0], [0], [0.0]] for _ in range(columns)]
        open_nodes = [[0] for _ in range(columns)]
        for level in range(depth):
            per = max(1, TABLE_MB * (1 << 20) // (24 * BINS * width * (1 << level)))
            ks = [k for k in range(columns) if open_nodes[k]]
            for at in range(0, len(ks), per):
                group = ks[at:at + per]
                as_arrays = [[np.array(c) for c in trees[k]] for k in group]
                make, shape = _histograms(width, classes, list(recent), as_arrays, [open_nodes[k] for k in group], group)
                hist = summed(table, make, int(np.prod(shape))).reshape(shape)
                for i, k in enumerate(group):
                    following = []
                    for j, node in enumerate(open_nodes[k]):
                        found = _best(hist[:, :, i, j])
                        tree = trees[k]
                        if found is None:
                            if node == 0:
                                tree[4][0] = value(hist[:, 0, i, j].sum(1))
                            continue
                        gain, f, b, low, high = found
                        importance[f] += gain
                        tree[0][node], tree[1][node] = f, b
                        tree[2][node], tree[3][node] = len(tree[0]), len(tree[0]) + 1
                        for sums in (low, high):
                            if sums[0] > 1:
                                following.append(len(tree[0]))
                            for c, v in zip(tree, (-1, 0, 0, 0, value(sums))):
                                c.append(v)
                    open_nodes[k] = following
        trees = [[np.array(c) for c in tree] for tree in trees]
        done.append(trees)
        recent.append(trees)
        if len(recent) == REFRESH and t + 1 < rounds:
            old, apply = table, list(recent)

            def refresh(batches):
                for b in batches:
                    new = [_add_trees(s, bins, apply).tobytes() for bins, _, s in _rows(b, width, classes)]
                    yield b.set_column(b.schema.get_field_index("scores"), "scores", pa.array(new, pa.binary()))

            table = _stage(old.mapInArrow(refresh, old.schema))
            table.count()
            old.unpersist()
            recent = []
    table.unpersist()
    return done, importance


# --------------------------------------------------------------- estimator
def _bin(x: np.ndarray, edges: list) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8, order="F")
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f], "left") + 1)
    return out


def _fitted_state(df: DataFrame, c: dict, classes: int) -> dict:
    """Bins, staged table and rounds of a model, as its JSON state."""
    data = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    data = data.where("label is not null").persist(StorageLevel.MEMORY_AND_DISK)
    if classes:
        counts = {int(r["label"]): r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(counts.values())
        prior = np.log(np.maximum([counts.get(k, 0) / max(n, 1) for k in range(classes)], 1e-12))
    else:
        n, mean = data.agg(F.count("label"), F.avg("label")).first()
        prior = np.array([mean or 0.0])
    width = len(data.first()["x"]) if n else 0
    probs = [i / (BINS - 1) for i in range(1, BINS - 1)]
    names = [f"x{i}" for i in range(width)]
    wide = data.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"x{i}") for i in range(width)])
    edges = [np.array(sorted(set(e)), np.float64) for e in wide.approxQuantile(names, probs, 0.25 / BINS)] if n else []

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                parts = (_bin(x, edges).T, np.asarray(b.column("label")), np.tile(prior.astype(np.float64), b.num_rows))
                yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in parts], names=["bins", "label", "scores"])

    trees, gain = [], np.zeros(width)
    if n:
        table = _stage(fitting(data, n).mapInArrow(pack, "bins binary, label binary, scores binary"))
        trees, gain = grow(table, width, classes, int(c.get("rounds", 100)), int(c.get("depth", 3)), float(c.get("rate", 0.1)))
    data.unpersist()
    return {"prior": prior.tolist(), "edges": [e.tolist() for e in edges],
            "gain": (gain / gain.sum() if gain.sum() > 0 else gain).tolist(),
            "trees": [[[a.tolist() for a in t] for t in r] for r in trees]}


class SoftmaxBoosting(JsonEstimator):
    """config: classes, rounds (100), depth (3), rate (0.1). Reads
    ``features`` (vector) and ``label`` (0 .. classes - 1)."""

    def _fit(self, df: DataFrame) -> "SoftmaxBoostingModel":
        return SoftmaxBoostingModel(config=self.conf, state=_fitted_state(df, self.conf, int(self.conf["classes"])))


class SquareBoosting(JsonEstimator):
    """Regression. config: rounds (100), depth (3), rate (0.1). Reads
    ``features`` (vector) and ``label``."""

    def _fit(self, df: DataFrame) -> "SquareBoostingModel":
        return SquareBoostingModel(config=self.conf, state=_fitted_state(df, self.conf, 0))


def _score_column(text: str, finish):
    """Pandas function from feature arrays to ``finish`` of the scores."""
    def run(parts):
        s = json.loads(text)
        edges = [np.array(e) for e in s["edges"]]
        rounds = [[[np.array(a) for a in t] for t in r] for r in s["trees"]]
        prior = np.array(s["prior"])
        for x in parts:
            x = np.stack(x) if len(x) else np.zeros((0, len(edges)))
            yield pd.Series(list(finish(_add_trees(np.tile(prior, (len(x), 1)), _bin(x, edges), rounds))))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


class SquareBoostingModel(JsonStateModel):
    """Adds prediction."""

    @property
    def featureImportances(self):
        return Vectors.dense(self.fitted["gain"])

    def _transform(self, df: DataFrame) -> DataFrame:
        score = F.pandas_udf(_score_column(self.getOrDefault(self.state), lambda s: s[:, 0]), "double")
        return df.withColumn("prediction", score(vector_to_array("features")))


class SoftmaxBoostingModel(JsonStateModel):
    """Adds probability (vector) and prediction (double, the first class of
    greatest probability)."""

    @property
    def featureImportances(self):
        return Vectors.dense(self.fitted["gain"])

    def _transform(self, df: DataFrame) -> DataFrame:
        score = F.pandas_udf(_score_column(self.getOrDefault(self.state), _softmax), "array<double>")
        got = df.withColumn("__p", score(vector_to_array("features")))
        best = F.array_position("__p", F.array_max("__p")).cast("double") - 1
        return got.withColumns({"probability": array_to_vector("__p"), "prediction": best}).drop("__p")
