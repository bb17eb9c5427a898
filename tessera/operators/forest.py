"""Decision trees and forests without a depth limit (TRN3, TRN4, TRN9, SEL6,
SEL8, SEL9).

Nodes with many rows are split by histograms: a pass adds up, per tree, node,
column and bin, what the split rule needs; a tree's sums meet in one task, and
only the splits chosen there reach the driver.
A node that no bin edge parts gets edges from its own rows; if these part it
neither, its rows are equal and it is a leaf. As soon as a node holds at most ``task_rows`` rows, its rows go to one task,
``groupBy(tree, node)``. The task splits it by the same histograms while it has
more than ``local_rows`` rows, and grows the rest exactly, until every leaf
is pure or its rows are equal: all open nodes of a level at once, by sorted
prefix sums. The subtrees stay a table in the shared folder; the driver keeps only the
trees above them. A table of at most ``task_rows`` rows has no passes at all,
each of its trees is grown by one task.

A small forest goes to every task that scores. Of a larger one, rows are dealt
to the nodes they reach, meet the subtrees there (``cogroup``) and what all
trees say is added up per block of rows.

Bootstrap weights are Poisson(1) draws by a hash of (row, tree), so every pass
and every repeated task sees the same sample. Missing entries sort below all
values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fitted import JsonEstimator, JsonStateModel
from tessera.session import ensure_checkpoint_dir

LOCAL_ROWS = 32_768
TASK_NODES = 8          # times local_rows: rows of a node that go to one task, fewer of more than 8 columns
BINS = 64
TABLE_MB = 64           # histogram table of one pass; more nodes take more passes
MODEL_MB = 64           # larger forests are scored where their subtrees are
DEAL = 65_536           # rows dealt to the nodes at once
MEET = 500_000          # rows that meet a subtree in one task, about
_POISSON = np.cumsum([0.36787944117144233 / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(12)])


def _weights(uid: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    if not bootstrap:
        return np.ones(len(uid))
    x = uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0xD1B54A32D192ED03 + seed & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(_POISSON, u, "right").astype(float)


def _matrix(col, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.where(np.isnan(x), -np.inf, x)


def walk(tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row; tree = (column, threshold, left, right)."""
    col, cut, left, right = tree[:4]
    at = np.zeros(len(x), np.int64)
    live = np.arange(len(x)) if len(col) and col[0] >= 0 else np.zeros(0, np.int64)
    cells, first, n = x.ravel(), live * x.shape[1], np.zeros(len(live), np.int64)
    while len(live):                          # ``take`` is several times as fast as brackets
        low = cells.take(first + col.take(n)) <= cut.take(n)
        n = np.where(low, left.take(n), right.take(n))
        inner = col.take(n) >= 0
        if not inner.all():
            at[live[~inner]] = n[~inner]
            live, first, n = live[inner], first[inner], n[inner]
    return at


def _allowed(varies: np.ndarray, most: int, rng) -> np.ndarray:
    """Of each node's columns that vary, ``most`` at random."""
    if most >= varies.shape[1]:
        return varies
    key = np.where(varies, rng.random(varies.shape), np.inf)
    return varies & (key <= np.partition(key, most - 1, axis=1)[:, most - 1:most])


def _score(left: np.ndarray, whole: np.ndarray, classes: int) -> np.ndarray:
    """What a split gains, times the rows: drop of n * Gini or of the squared
    error. Last axis: class counts, or (n, sum)."""
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            part = lambda s: (s * s).sum(-1) / s.sum(-1)
        else:
            part = lambda s: s[..., 1] ** 2 / s[..., 0]
        return part(left) + part(right) - part(whole)


# ------------------------------------------------------------- in one task
def grow_local(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, most: int, rng):
    """A tree on all rows given: (column, threshold, left, right, value,
    mixed, importance). ``value`` is the mean, or a class, or -1 - row of
    ``mixed`` (class shares) for a leaf of several classes."""
    n, width = x.shape
    shift = 0.0 if classes else float(np.average(y, weights=w))
    stat = np.zeros((n, classes or 2))
    if classes:
        stat[np.arange(n), y.astype(np.int64)] = w
    else:
        stat[:, 0], stat[:, 1] = w, w * (y - shift)
    col, cut, left, right, value, mixed = [np.array([-1])], [np.zeros(1)], [np.zeros(1, int)], [np.zeros(1, int)], [], []
    gains, total, size = np.zeros(width), w.sum(), 1
    ids, at, rows = np.zeros(1, np.int64), np.zeros(n, np.int64), np.arange(n)     # open nodes; node and number of their rows
    sorted_rows = [np.argsort(x[:, f], kind="stable") for f in range(width)]       # the same rows by each column, node by node
    of = np.empty(n, np.uint16 if n <= 1 << 16 else np.int64)                      # next node of a row; 16 bits sort in one pass
    values = {}
    while len(ids):
        first = np.searchsorted(at, np.arange(len(ids)))
        last = np.append(first[1:], len(at)) - 1
        whole = np.add.reduceat(np.take(stat, rows, axis=0), first)
        if classes:
            share = whole / whole.sum(1, keepdims=True)
            pure = (whole > 0).sum(1) == 1
            here = np.where(pure, whole.argmax(1), -1 - len(mixed) - np.cumsum(~pure) + 1).astype(float)
            mixed.extend(share[~pure])
        else:
            own = np.maximum.reduceat(y[rows], first)
            pure = own == np.minimum.reduceat(y[rows], first)
            here = np.where(pure, own, whole[:, 1] / whole[:, 0] + shift)
        values[size - len(ids)] = here
        varies = np.stack([x[o[last], f] > x[o[first], f] for f, o in enumerate(sorted_rows)], 1)
        tried = _allowed(varies, most, rng)
        best = np.full((len(ids), width), -np.inf)
        spot = np.zeros((len(ids), width))
        for f in range(width):
            want = tried[:, f] & ~pure
            if not want.any():
                continue
            o, node = sorted_rows[f], at
            if classes and not want.all():          # counts add up exactly whichever nodes are left out
                some = want[at]
                o, node = o[some], at[some]
                names, start = np.unique(node, return_index=True)
            else:
                names, start = np.arange(len(ids)), first
            v = x[o, f]
            run = np.cumsum(np.take(stat, o, axis=0), axis=0)     # ``take`` picks rows ten times as fast as brackets
            before = np.where(start[:, None] > 0, run[np.maximum(start - 1, 0)], 0.0)
            ok = np.flatnonzero((v[1:] > v[:-1]) & (node[1:] == node[:-1]))
            if not len(ok):
                continue
            place = node[ok] if len(names) == len(ids) else np.searchsorted(names, node[ok])
            gain = np.full(len(v), -np.inf)
            gain[ok] = _score(np.take(run, ok, axis=0) - np.take(before, place, axis=0), np.take(whole, node[ok], axis=0), classes)
            top = np.maximum.reduceat(gain, start)
            i = ok[gain[ok] == top[place]]
            i = i[np.append(True, node[i[1:]] != node[i[:-1]])]
            low, high = v[i], v[i + 1]
            with np.errstate(invalid="ignore", over="ignore"):
                mid = low + (high - low) / 2
            spot[node[i], f] = np.where((mid >= low) & (mid < high), mid, low)
            best[names, f] = top
        best = np.where(tried, best, -np.inf)
        f = best.argmax(1)
        split = ~pure & np.isfinite(best[np.arange(len(ids)), f])
        np.add.at(gains, f[split], np.maximum(best[split, f[split]], 0.0))
        k = int(split.sum())
        col[-1] = np.where(split, f, -1)
        cut[-1] = np.where(split, spot[np.arange(len(ids)), f], 0.0)
        child = np.where(split, size + 2 * (np.cumsum(split) - 1), 0)
        left[-1], right[-1] = child, np.where(split, child + 1, 0)
        go = split[at]
        right_side = x[rows, f[at]] > cut[-1][at]
        of[rows[go]] = (2 * (np.cumsum(split) - 1)[at] + right_side)[go]
        stays = np.zeros(n, bool)
        stays[rows[go]] = True
        if k:
            for f, o in enumerate(sorted_rows):
                o = o[stays[o]]
                sorted_rows[f] = o[np.argsort(of[o], kind="stable")]
            rows = rows[go]
            rows = rows[np.argsort(of[rows], kind="stable")]
            at = of[rows].astype(np.int64)
        ids = np.arange(2 * k)
        size += 2 * k
        for part in (col, cut, left, right):
            part.append(np.zeros(2 * k))
    join = lambda p: np.concatenate(p[:-1] if len(p) > 1 else p)
    value = np.concatenate([values[k] for k in sorted(values)])
    return (join(col).astype(np.int32), join(cut).astype(float), join(left).astype(np.int32),
            join(right).astype(np.int32), value, np.array(mixed).reshape(-1, classes or 1), gains / max(total, 1e-300))


def _whole(top, subtrees, classes: int) -> list[np.ndarray]:
    """One tree from a top (its arrays) and subtrees (node, arrays)."""
    blocks, mixed = [[a.copy()] for a in top[:5]], [top[5]]
    size, k = len(top[0]), len(top[5])
    for node, (col, cut, left, right, value, own) in subtrees:
        left, right = (np.where(col >= 0, a + size - 1, 0) for a in (left, right))   # its root takes the leaf's place
        if classes:
            value = np.where(value < 0, value - k, value)
            mixed.append(own)
            k += len(own)
        for block, a in zip(blocks, (col, cut, left, right, value)):
            block[0][node] = a[0]
            block.append(a[1:])
        size += len(col) - 1
    return [np.concatenate(b) for b in blocks] + [np.vstack(mixed)]


def _level_order(tree) -> list[np.ndarray]:
    """The tree with its levels one after the other."""
    col, cut, left, right, value, mixed = tree
    levels = [np.zeros(1, np.int64)]
    while len(inner := levels[-1][col[levels[-1]] >= 0]):
        levels.append(np.stack([left[inner], right[inner]], 1).ravel().astype(np.int64))
    order = np.concatenate(levels)
    col = col[order]
    first = np.where(col >= 0, 2 * np.cumsum(col >= 0) - 1, 0)
    return [col, cut[order], first, np.where(col >= 0, first + 1, 0), value[order], mixed]


def grow_node(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: dict, key: tuple, edges):
    """As ``grow_local``, of any number of rows: nodes of more than local_rows
    rows are split at the whole table's bin edges, as by passes. One that no
    edge parts is grown exactly."""
    k, s, width = c["classes"], c["classes"] or 3, x.shape[1]
    exact = lambda rows, *more: grow_local(x[rows], y[rows], w[rows], k, c["most"], np.random.default_rng([*key, *more]))
    if w.sum() <= c["local_rows"]:
        return exact(slice(None))
    binned = [np.searchsorted(edges[f], x[:, f], "left").astype(np.uint8 if BINS <= 256 else np.int64) for f in range(width)]
    dy = None if k else w * (y - c["shift"])
    top, below, gains = _Top(), [], np.zeros(width)
    open_nodes = [(0, np.arange(len(x)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        weight = w[rows]
        kind = "small"
        if weight.sum() > c["local_rows"]:
            hist = np.zeros((width, BINS, s))
            for f in range(width):
                at = binned[f][rows].astype(np.int64)
                if k:
                    hist[f] = np.bincount(at * s + y[rows].astype(np.int64), weight, BINS * s).reshape(BINS, s)
                else:
                    hist[f, :, 0], hist[f, :, 1] = np.bincount(at, weight, BINS), np.bincount(at, dy[rows], BINS)
                    if not f:
                        hist[f, :, 2] = np.bincount(at, dy[rows] * (y[rows] - c["shift"]), BINS)
            kind, f, b, gain, _, whole = _choice(hist, c, width, (*key, node), False)
        if kind == "split":
            gains[f] += max(gain, 0.0)
            top.col[node], top.cut[node] = f, float(edges[f][b])
            low = binned[f][rows] <= b
            for side, part in (("left", low), ("right", ~low)):
                new = top.add(0)
                getattr(top, side)[node] = new
                open_nodes.append((new, rows[part]))
        elif kind == "leaf":
            top.leaf(node, np.array(whole), k, c["shift"])
        else:
            got = exact(rows, node)
            below.append((node, got[:6]))
            gains += got[6] * weight.sum()
    tree = _whole([*top.arrays(), np.array(top.value), np.array(top.mixed).reshape(-1, max(k, 1))], below, k)
    return (*_level_order(tree), gains / max(w.sum(), 1e-300))


# a node is its column (-1: leaf) and a number, its threshold or its value; the
# k-th inner node has the children 2k + 1 and 2k + 2
_SUBTREE = ("tree int, node int, col binary, number binary, mixed binary, nodes long, deep int, rows double, gains array<double>")


def _packed(got) -> dict:
    """Columns of a subtree's row."""
    col, cut, left, _, value, mixed = got[:6]
    deep, at, size = 0, 0, 1                  # levels lie one after the other
    while (inner := int((col[at:at + size] >= 0).sum())):
        deep, at, size = deep + 1, at + size, 2 * inner
    return {"col": col.astype(np.int32).tobytes(), "number": np.where(col >= 0, cut, value).tobytes(),
            "mixed": np.ascontiguousarray(mixed, np.float64).tobytes(), "nodes": len(col), "deep": deep}


def _unpacked(row: dict, classes: int) -> list[np.ndarray]:
    """(column, threshold, left, right, value, mixed) of a subtree's row."""
    col, number = np.frombuffer(row["col"], np.int32), np.frombuffer(row["number"])
    inner = col >= 0
    left = np.where(inner, 2 * np.cumsum(inner) - 1, 0)
    return [col, np.where(inner, number, 0.0), left, np.where(inner, left + 1, 0), np.where(inner, 0.0, number),
            np.frombuffer(row["mixed"]).reshape(-1, max(classes, 1))]


def _chunks(batches, width: int, most: int):
    """(x, arrays of the other columns) of up to about ``most`` rows."""
    def whole(held):
        table = pa.Table.from_batches(held).combine_chunks()
        return _matrix(table["x"], width), {c: table[c].to_numpy() for c in table.column_names if c != "x"}

    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, most):
            held.append(b.slice(at, most))
            n += held[-1].num_rows
            if n >= most:
                yield whole(held)
                held, n = [], 0
    if n:
        yield whole(held)


def _blobs(at: np.ndarray, **columns) -> tuple[np.ndarray, dict]:
    """Groups of rows by ``at``: (its values, per column one binary a group)."""
    order = np.argsort(at, kind="stable")
    names, first = np.unique(at[order], return_index=True)
    ends = np.append(first, len(at))
    out = {}
    for c, v in columns.items():
        v = np.take(v, order, axis=0)
        offsets = (ends * (v.itemsize * (v.shape[1] if v.ndim > 1 else 1))).astype(np.int32)
        out[c] = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(v))])
    return names, out


def _joined(blobs, kind=np.float64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind)] + [np.frombuffer(v.as_buffer(), kind) for v in blobs])


def _parts(spark) -> int:
    # a tree's rows are few bytes and much work: as many tasks as there are
    # cores, not as few as the bytes ask for
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _local(data: DataFrame, tops: list, c: dict, width: int, edges) -> DataFrame:
    """Subtrees of the nodes that go to tasks, one row each."""
    walks, small = [t.arrays() for t in tops], [np.array(t.grow) for t in tops]

    def deal(batches):
        for x, more in _chunks(batches, width, min(DEAL, max(1_024, (64 << 20) // (8 * width)))):
            uid, y = more["uid"].astype(np.int64), more["y"].astype(np.float64)
            for t, (top, nodes) in enumerate(zip(walks, small)):
                if not nodes.any():
                    continue
                at = walk(top, x)
                hit = np.flatnonzero((_weights(uid, t, c["seed"], c["bootstrap"]) > 0) & nodes[at])
                if len(hit):
                    names, blobs = _blobs(at[hit], uid=uid[hit], y=y[hit], x=np.take(x, hit, axis=0))
                    yield pa.record_batch({"tree": pa.array(np.full(len(names), t, np.int32)),
                                           "node": pa.array(names.astype(np.int32)), **blobs})

    def grow(key, table):
        t, node = key[0].as_py(), key[1].as_py()
        uid = _joined(table["uid"], np.int64)
        order = np.argsort(uid, kind="stable")           # results do not depend on the order rows arrive in
        x, y = np.take(_joined(table["x"]).reshape(-1, width), order, axis=0), _joined(table["y"])[order]
        w = _weights(uid[order], t, c["seed"], c["bootstrap"])
        got = grow_node(x, y, w, c, (c["seed"], t, node), edges)
        return pa.Table.from_pylist([{"tree": t, "node": node, **_packed(got), "rows": float(w.sum()), "gains": got[6].tolist()}],
                                    pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("col", pa.binary()),
                                               ("number", pa.binary()), ("mixed", pa.binary()), ("nodes", pa.int64()),
                                               ("deep", pa.int32()), ("rows", pa.float64()), ("gains", pa.list_(pa.float64()))]))

    sent = data.mapInArrow(deal, "tree int, node int, uid binary, y binary, x binary")
    return sent.repartition(_parts(data.sparkSession), "tree", "node").groupBy("tree", "node").applyInArrow(grow, _SUBTREE)


# ------------------------------------------------------------- by passes
class _Top:
    """A tree down to nodes that one task can take: its arrays, per node the
    set of bin edges it is split by, whether its rows go to a task, and the
    value of nodes that are leaves already."""

    def __init__(self):
        self.col, self.cut, self.left, self.right = [-1], [0.0], [0], [0]
        self.edges, self.grow, self.value, self.mixed = [0], [True], [0.0], []

    def add(self, edges: int) -> int:
        for part, v in ((self.col, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.edges, edges),
                        (self.grow, True), (self.value, 0.0)):
            part.append(v)
        return len(self.col) - 1

    def leaf(self, node: int, sums: np.ndarray, classes: int, shift: float) -> None:
        self.grow[node] = False
        if not classes:
            self.value[node] = sums[1] / sums[0] + shift
        elif (sums > 0).sum() == 1:
            self.value[node] = float(sums.argmax())
        else:
            self.mixed.append(sums / sums.sum())
            self.value[node] = -float(len(self.mixed))

    def arrays(self) -> list[np.ndarray]:
        return [np.array(self.col), np.array(self.cut, float), np.array(self.left), np.array(self.right)]


def _splits(data: DataFrame, group, tops, open_nodes, edge_sets, own, c, width):
    """What becomes of the open nodes of some trees: rows (tree, place among
    its open nodes, kind, column, bin, gain, sums of the left side, of all)."""
    s = c["classes"] or 3
    walks = {t: tops[t].arrays() for t in group}
    sets = {t: np.array([tops[t].edges[k] for k in open_nodes[t]]) for t in group}
    used = {e: edge_sets[e] for e in np.unique(np.concatenate(list(sets.values())))}
    nodes = {t: list(open_nodes[t]) for t in group}
    tried = {t: [(t, node) in own for node in nodes[t]] for t in group}

    def add(batches):
        from pyspark import TaskContext
        total = {t: np.zeros((len(nodes[t]), width, BINS, s)) for t in group}
        for b in batches:
            x, y, uid = _matrix(b.column("x"), width), np.asarray(b.column("y")), np.asarray(b.column("uid"))
            dy = y - c["shift"]
            binned = {}
            for t in group:
                w = _weights(uid, t, c["seed"], c["bootstrap"])
                slot = np.full(len(walks[t][0]), -1, np.int64)
                slot[nodes[t]] = np.arange(len(nodes[t]))
                drawn = np.flatnonzero(w > 0)
                place = slot[walk(walks[t], np.take(x, drawn, axis=0))]
                drawn, place = drawn[place >= 0], place[place >= 0]
                kinds = np.unique(sets[t])
                for e in kinds:
                    if e not in binned:
                        binned[e] = [np.searchsorted(used[e][f], x[:, f], "left") for f in range(width)]
                    hit, node = drawn, place
                    if len(kinds) > 1:
                        hit, node = (v[sets[t][place] == e] for v in (hit, node))
                    node, weight, d = node * BINS, w[hit], dy[hit]
                    for f in range(width):
                        at = node + binned[e][f][hit]
                        if c["classes"]:
                            got = np.bincount(at * s + y[hit].astype(np.int64), weight, len(nodes[t]) * BINS * s)
                            total[t][:, f] += got.reshape(-1, BINS, s)
                            continue
                        for k, v in enumerate((weight, weight * d, weight * d ** 2)[:2 if f else 3]):   # squares: of a node
                            total[t][:, f, :, k] += np.bincount(at, v, len(nodes[t]) * BINS).reshape(-1, BINS)
        part = TaskContext.get().partitionId()
        for t in group:
            yield pa.record_batch({"tree": pa.array([t], pa.int32()), "part": pa.array([part], pa.int32()),
                                   "sums": pa.array([total.pop(t).tobytes()], pa.binary())})

    def choose(table):
        t = table["tree"][0].as_py()
        hist = np.zeros((len(nodes[t]), width, BINS, s))
        for v in table.sort_by("part")["sums"]:
            hist += np.frombuffer(v.as_buffer()).reshape(hist.shape)
        out = [_choice(h, c, width, (c["seed"], t, node), known) for h, node, known in zip(hist, nodes[t], tried[t])]
        kind, f, b, gain, low, whole = zip(*out)
        return pa.table({"tree": pa.array([t] * len(out), pa.int32()), "place": pa.array(range(len(out)), pa.int32()),
                         "kind": pa.array(kind), "f": pa.array(f, pa.int32()), "b": pa.array(b, pa.int32()),
                         "gain": pa.array(gain, pa.float64()), "low": pa.array(low, pa.list_(pa.float64())),
                         "whole": pa.array(whole, pa.list_(pa.float64()))})

    sums = data.mapInArrow(add, "tree int, part int, sums binary")
    return sums.groupBy("tree").applyInArrow(
        choose, "tree int, place int, kind string, f int, b int, gain double, low array<double>, whole array<double>").collect()


def _choice(hist: np.ndarray, c: dict, width: int, key: tuple, known: bool) -> tuple:
    """A node by its histograms (column, bin, sums): ``known`` if the edges
    are of its own rows."""
    k = c["classes"]
    low = hist.cumsum(1)
    whole = low[:, -1:]
    sums = whole[0, 0]
    size = lambda v: v.sum(-1) if k else v[..., 0]
    valid = (size(low) > 0) & (size(whole - low) > 0)
    if k:
        same = (sums > 0).sum() == 1
    else:               # by rounded sums; its rows will tell
        same = not known and sums[2] - sums[1] ** 2 / sums[0] <= 1e-9 * sums[2]
    if (k and same) or (not valid.any() and known):
        return "leaf", 0, 0, 0.0, [], sums.tolist()
    if same or not valid.any():
        return "stuck", 0, 0, 0.0, [], sums.tolist()
    gain = np.where(valid, _score(low, whole, k), -np.inf)
    ok = _allowed(valid.any(1)[None], c["most"], np.random.default_rng([*key, 1]))[0]
    gain = np.where(ok[:, None], gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return "split", int(f), int(b), float(gain[f, b]), low[f, b].tolist(), whole[f, 0].tolist()


def _edges(data: DataFrame, width: int) -> list:
    wide = data.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"x{i}") for i in range(width)])
    probs = [i / BINS for i in range(1, BINS)]
    return [np.array(sorted(set(e))) for e in wide.approxQuantile([f"x{i}" for i in range(width)], probs, 0.25 / BINS)]


def _finer_edges(data: DataFrame, stuck: list, tops, c, width: int) -> dict:
    """(tree, node) -> (bin edges, least and greatest target) from the rows of
    that node alone: nodes whose rows lie between two edges of the set they
    had, or whose targets look equal."""
    masks = {}
    for t, node in stuck:
        masks.setdefault(t, np.zeros(len(tops[t].col), bool))[node] = True
    walks = {t: tops[t].arrays() for t in masks}

    def deal(batches):
        for b in batches:
            lists = b.column("x")
            x, uid = _matrix(lists, width), np.asarray(b.column("uid"))
            for t, mask in masks.items():
                at = walk(walks[t], x)
                hit = np.flatnonzero(mask[at] & (_weights(uid, t, c["seed"], c["bootstrap"]) > 0))
                yield pa.record_batch({"tree": pa.array(np.full(len(hit), t, np.int32)),
                                       "node": pa.array(at[hit].astype(np.int32)), "x": lists.take(pa.array(hit)),
                                       "y": b.column("y").take(pa.array(hit))})

    rows = data.select("x", "uid", "y").mapInArrow(deal, "tree int, node int, x array<double>, y double")
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    got = rows.groupBy("tree", "node").agg(*[
        F.percentile_approx(F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]), probs, F.lit(8 * BINS)).alias(f"e{f}")
        for f in range(width)], F.min("y").alias("least"), F.max("y").alias("most"))
    return {(r["tree"], r["node"]): ([np.array(sorted(set(r[f"e{f}"] or []))) for f in range(width)], r["least"], r["most"])
            for r in got.collect()}


def _top(data: DataFrame, c: dict, width: int, n: int):
    """The trees' tops, their gains by column and the whole table's bin edges.
    A node is split at a bin edge while it has more than task_rows rows; one
    that no edge parts gets edges of its own rows, and is a leaf if these do
    not part it either (its rows are equal)."""
    tops = [_Top() for _ in range(c["trees"])]
    gains = np.zeros((c["trees"], width))
    edges = _edges(data, width) if n > c["local_rows"] else [np.zeros(0)] * width
    if n <= c["task_rows"]:
        return tops, gains, edges
    k, s = c["classes"], c["classes"] or 3
    edge_sets, own = [edges], set()     # own: (tree, node) with edges of its own rows
    open_nodes = [[0] for _ in tops]
    while any(open_nodes):
        todo = [t for t in range(len(tops)) if open_nodes[t]]
        following, stuck, at = [[] for _ in tops], [], 0
        while at < len(todo):
            group = [todo[at]]
            while at + len(group) < len(todo) and 8 * width * BINS * s * sum(
                    len(open_nodes[t]) for t in todo[at:at + len(group) + 1]) <= TABLE_MB << 20:
                group.append(todo[at + len(group)])
            at += len(group)
            found = _splits(data, group, tops, open_nodes, edge_sets, own, c, width)
            for r in sorted(found, key=lambda r: (r["tree"], r["place"])):
                t, node = r["tree"], open_nodes[r["tree"]][r["place"]]
                top, f, low, whole = tops[t], r["f"], np.array(r["low"]), np.array(r["whole"])
                if r["kind"] == "leaf":
                    top.leaf(node, whole, k, c["shift"])
                    continue
                if r["kind"] == "stuck":
                    stuck.append((t, node))
                    continue
                gains[t, f] += max(r["gain"], 0.0) / n
                top.col[node], top.cut[node] = f, float(edge_sets[top.edges[node]][f][r["b"]])
                for side, part in (("left", low), ("right", whole - low)):
                    new = top.add(top.edges[node])
                    getattr(top, side)[node] = new
                    if k and (part > 0).sum() == 1:
                        top.leaf(new, part, k, c["shift"])
                    elif float(part.sum() if k else part[0]) > c["task_rows"]:
                        following[t].append(new)
        if stuck:
            for (t, node), (finer, least, most) in _finer_edges(data, stuck, tops, c, width).items():
                if not k and least == most:
                    tops[t].grow[node], tops[t].value[node] = False, least
                    continue
                edge_sets.append(finer)
                tops[t].edges[node] = len(edge_sets) - 1
                following[t].append(node)
            own.update(stuck)
        open_nodes = following
    return tops, gains, edges


# --------------------------------------------------------------- estimator
class Forest(JsonEstimator):
    """config: classes (0 for a regressor), trees, most (columns tried per
    split: "sqrt" or "all"), bootstrap, seed, local_rows."""

    def _fit(self, df: DataFrame) -> "ForestModel":
        conf = {"classes": 0, "trees": 200, "most": "all", "bootstrap": True, "seed": 42, "local_rows": LOCAL_ROWS} | self.conf
        spark = df.sparkSession
        folder = f"{ensure_checkpoint_dir(spark)}/forest/{uuid.uuid4().hex}"
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        rows.where("y is not null").withColumn("uid", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
        data = spark.read.parquet(f"{folder}/rows")
        n, level = data.agg(F.count("y"), F.avg("y")).first()
        if not n:
            raise ValueError("no labelled rows to learn from")
        width = len(data.first()["x"])
        # one partition per core at least, by a hash of the row
        cores = spark.sparkContext.defaultParallelism
        if data.rdd.getNumPartitions() < cores and n > 4 * cores:
            data = data.repartition(cores, "uid")
        most = max(1, int(np.sqrt(width))) if conf["most"] == "sqrt" else width
        c = {**conf, "most": most, "shift": float(level),
             "task_rows": conf["local_rows"] * max(1, min(TASK_NODES, 8 * TASK_NODES // width))}
        tops, gains, edges = _top(data, c, width, n)
        _local(data, tops, c, width, edges).write.parquet(f"{folder}/subtrees")
        trees = [[*t.arrays(), np.array(t.value), np.array(t.mixed).reshape(-1, max(c["classes"], 1))] for t in tops]
        return ForestModel(config=c, state={"width": width})._set_trees(
            trees, f"{folder}/subtrees", _importance(spark.read.parquet(f"{folder}/subtrees"), gains))


def _importance(subtrees: DataFrame, gains: np.ndarray) -> np.ndarray:
    """Mean of the trees' shares by column, from the tops' gains and those of
    the subtrees, each tree's added up in one task."""
    def add(table):
        table = table.sort_by("node")
        rows, own = table["rows"].to_numpy(), np.array(table["gains"].to_pylist())
        total = gains[table["tree"][0].as_py()]
        for r, g in zip(rows, own):
            total = total + g * r / (rows.sum() or 1.0)
        return pa.table({"tree": table["tree"][:1], "shares": pa.array([total.tolist()])})

    found = subtrees.select("tree", "node", "rows", "gains").groupBy("tree").applyInArrow(add, "tree int, shares array<double>")
    shares = {r["tree"]: np.array(r["shares"]) for r in found.collect()}
    per = np.array([shares.get(t, g) for t, g in enumerate(gains)])
    size = per.sum(1, keepdims=True)
    total = np.where(size > 0, per / np.where(size > 0, size, 1.0), per).mean(0)
    return total / total.sum() if total.sum() > 0 else total


def _assemble(tops, subtrees: DataFrame, classes: int):
    """Whole trees from the tops and their subtrees."""
    parts: dict = {}
    for b in subtrees.select("tree", "node", "col", "number", "mixed").toArrow().to_batches():
        for row in b.to_pylist():
            parts.setdefault(row["tree"], []).append(row)
    trees = []
    for t, top in enumerate(tops):
        found = sorted(parts.pop(t, []), key=lambda r: r["node"])
        trees.append(_whole(top, [(r["node"], _unpacked(r, classes)) for r in found], classes))
    return trees


class ForestModel(JsonStateModel):
    """Adds prediction; a classifier also probability (vector). The subtrees
    are a Parquet table, when saved beside the parameters. A stream is scored
    by the whole forest in every task, whatever its size."""

    def _set_trees(self, tops, path: str, importance) -> "ForestModel":
        self._tops, self._path, self._importance = tops, path, np.asarray(importance)
        self._sent = self._mb = None
        return self

    @property
    def featureImportances(self):
        return Vectors.dense(self._importance)

    def _subtrees(self) -> DataFrame:
        return SparkSession.getActiveSession().read.parquet(self._path)

    @property
    def depth(self) -> int:
        """Of the deepest tree."""
        below = {(r["tree"], r["node"]): r["deep"] for r in self._subtrees().select("tree", "node", "deep").collect()}
        most = 0
        for t, top in enumerate(self._tops):
            level, deep = [0], 0
            while level:
                most = max([most] + [deep + below.get((t, n), 0) for n in level])
                level, deep = [int(k) for n in level if top[0][n] >= 0 for k in (top[2][n], top[3][n])], deep + 1
        return most

    def _transform(self, df: DataFrame) -> DataFrame:
        c, width = self.conf, self.fitted["width"]
        if self._mb is None:
            size = self._subtrees().agg(F.sum("nodes"), F.sum(F.length("mixed"))).first()
            self._mb = (32 * (size[0] or 0) + (size[1] or 0)) / 1e6
        if self._mb > MODEL_MB and not df.isStreaming:
            return self._answer(self._met(df), c["classes"])
        if self._sent is None:
            self._sent = df.sparkSession.sparkContext.broadcast(
                [[t[0].astype(np.int32), t[1], t[2].astype(np.int32), t[3].astype(np.int32), *t[4:]]
                 for t in _assemble(self._tops, self._subtrees(), c["classes"])])
        sent, classes = self._sent, c["classes"]

        def score(parts):
            for lists in parts:
                x = np.stack(lists) if len(lists) else np.zeros((0, width))
                x = np.where(np.isnan(x), -np.inf, x)
                total = np.zeros((len(x), classes or 1))
                for tree in sent.value:
                    got = tree[4][walk(tree, x)]
                    if not classes:
                        total[:, 0] += got
                        continue
                    pure = np.flatnonzero(got >= 0)
                    total[pure, got[pure].astype(np.int64)] += 1
                    other = np.flatnonzero(got < 0)
                    total[other] += tree[5][(-1 - got[other]).astype(np.int64)]
                yield pd.Series(list(total / len(sent.value)))

        score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        got = df.withColumn("__f", F.pandas_udf(score, "array<double>")(vector_to_array("features")))
        return self._answer(got, classes)

    @staticmethod
    def _answer(got: DataFrame, classes: int) -> DataFrame:
        if not classes:
            return got.withColumn("prediction", F.col("__f")[0]).drop("__f")
        best = F.array_position("__f", F.array_max("__f")).cast("double") - 1
        return got.withColumns({"probability": array_to_vector("__f"), "prediction": best}).drop("__f")

    def _met(self, df: DataFrame) -> DataFrame:
        """``df`` with the trees' mean: rows meet the subtrees of the nodes
        they reach, a block's answers are added up in the order of the trees."""
        spark, c, width = df.sparkSession, self.conf, self.fitted["width"]
        tops, classes = self._tops, c["classes"]
        path = f"{ensure_checkpoint_dir(spark)}/forest/{uuid.uuid4().hex}"
        df.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        block = max(256, min(10_000, (1 << 21) // (len(tops) * max(classes, 1))))
        inner = min(sum(n >= 0 for n in t[0]) for t in tops)
        copies = 1 + rows.count() // (MEET * (inner + 1))      # of a subtree, for as many groups of blocks

        def deal(batches):
            for x, more in _chunks(batches, width, block):
                row = more["__row"]
                for t, top in enumerate(tops):
                    names, blobs = _blobs(walk(top, x), row=row, x=x)
                    yield pa.record_batch({"tree": pa.array(np.full(len(names), t, np.int32)),
                                           "node": pa.array(names.astype(np.int32)),
                                           "copy": pa.array(np.full(len(names), int(row[0]) // block % copies, np.int32)),
                                           "block": pa.array(np.full(len(names), row[0], np.int64)), **blobs})

        def meet(key, left, right):
            t, node = key[0].as_py(), key[1].as_py()
            if right.num_rows:
                tree = _unpacked({k: right[k][0].as_py() for k in ("col", "number", "mixed")}, classes)
            else:                                   # a leaf of the top
                tree = [np.array([-1]), *[np.zeros(1)] * 3, tops[t][4][node:node + 1], tops[t][5]]
            for b in left.to_batches():
                size = np.array([len(v.as_buffer()) for v in b.column("row")]) // 8
                got = tree[4][walk(tree, _joined(b.column("x")).reshape(-1, width))]
                cut = np.append(0, np.cumsum(size))
                other = [np.take(tree[5], (-1 - g[g < 0]).astype(np.int64), axis=0).tobytes() if classes else b""
                         for g in (got[i:j] for i, j in zip(cut[:-1], cut[1:]))]
                yield pa.record_batch({"block": b.column("block"), "tree": b.column("tree"), "row": b.column("row"),
                                       "got": pa.array([got[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                                       "mixed": pa.array(other, pa.binary())})

        def add(table):
            table = table.sort_by("tree")
            names = np.unique(_joined(table["row"], np.int64))
            total = np.zeros((len(names), classes or 1))
            for row, got, mixed in zip(table["row"], table["got"], table["mixed"]):
                at, got = np.searchsorted(names, np.frombuffer(row.as_buffer(), np.int64)), np.frombuffer(got.as_buffer())
                if not classes:
                    total[at, 0] += got
                    continue
                pure = got >= 0
                total[at[pure], got[pure].astype(np.int64)] += 1
                total[at[~pure]] += np.frombuffer(mixed.as_buffer()).reshape(-1, classes)
            mean = (total / len(tops)).ravel()
            return pa.table({"__row": names, "__f": pa.ListArray.from_arrays(
                np.arange(len(names) + 1, dtype=np.int32) * (classes or 1), mean)})

        def met(key, left, right):
            got = list(meet(key, left, right)) if left.num_rows else []
            return pa.Table.from_batches(got, _MET)

        sent = rows.select("__row", vector_to_array("features").alias("x")).mapInArrow(
            deal, "tree int, node int, copy int, block long, row binary, x binary")
        subtrees = self._subtrees().select("tree", "node", F.explode(F.array(*map(F.lit, range(copies)))).alias("copy"),
                                           "col", "number", "mixed")
        parts, by = _parts(spark), ("tree", "node", "copy")
        answers = sent.repartition(parts, *by).groupBy(*by).cogroup(subtrees.repartition(parts, *by).groupBy(*by)).applyInArrow(
            met, "block long, tree int, row binary, got binary, mixed binary")
        scores = answers.groupBy("block").applyInArrow(add, "__row long, __f array<double>")
        return rows.join(scores, "__row").drop("__row")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


_MET = pa.schema([("block", pa.int64()), ("tree", pa.int32()), ("row", pa.binary()), ("got", pa.binary()), ("mixed", pa.binary())])
_TOPS = "tree int, col array<int>, cut array<double>, left array<int>, right array<int>, value array<double>, mixed array<double>"


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark,
                                         extraMetadata={"importance": self.model._importance.tolist()})
        rows = [(i, *[np.ravel(a).tolist() for a in (t[0].astype(int), t[1], t[2].astype(int), t[3].astype(int), t[4], t[5])])
                for i, t in enumerate(self.model._tops)]
        spark.createDataFrame(rows, _TOPS).write.parquet(f"{path}/tops")
        self.model._subtrees().write.parquet(f"{path}/subtrees")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        spark = SparkSession.getActiveSession()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        k = max(model.conf["classes"], 1)
        rows = spark.read.parquet(f"{path}/tops").orderBy("tree").collect()
        tops = [[np.array(r["col"]), np.array(r["cut"]), np.array(r["left"]), np.array(r["right"]), np.array(r["value"]),
                 np.array(r["mixed"]).reshape(-1, k)] for r in rows]
        return model._set_trees(tops, f"{path}/subtrees", np.array(meta["importance"]))
