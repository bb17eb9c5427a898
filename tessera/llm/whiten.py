"""Embedding whitening by FEAST contour integration.

The covariance of the quantised vectors is gathered exactly, as integers: tasks
shift their vectors by the integer nearest each mean, multiply, and Spark adds
the products; the covariance that follows is the one of the centred vectors, to
the last bit, in whatever order tasks end. Its size is dimension squared and
does not grow with the rows. Its leading eigenpairs come from contour
integrals: the quadrature of shifted solves ``(zI - V)^-1 Y`` around an
interval projects onto the eigenvectors in it, a Rayleigh-Ritz step extracts
them, and this repeats until the residuals are at rounding level. The interval
is found by inertia counts (signs of an LDL' factorisation of ``V - sI``),
which also say how many pairs must come out of it.

Defined results: vectors that are null or hold null or non-finite entries take
no part; nor do entries of 2^30 or more in magnitude, whose 1024-fold does not
go with exact sums; of vectors of several lengths the most frequent length (the
shorter in a tie) is the dimension, the rest take no part. Repeated rows count
as often as they occur, a null id stays a null id. Equal eigenvalues give some
orthonormal basis of their space. Directions without variance (rank below
``k``, one row, equal rows) cannot be whitened: only components whose eigenvalue
is above rounding level are returned. No usable vector: no rows. Only the id
and vector columns are read, so others may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, stage

SCALE, OFFSET = 1024, 100_000
_LARGE = float(1 << 30)
_NODES = 16           # quadrature points on the half circle
_EXACT = 1 << 53      # integers below are exact in double precision
_DEC = pa.decimal128(38, 0)


# ------------------------------------------------------- exact statistics

def _usable(col, dim: int | None = None):
    """By length (or only ``dim``): rows whose entries are all finite, and
    their quantised values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    for d in np.unique(size[size > 0]) if dim is None else [dim]:
        rows = np.flatnonzero(size == d)
        if not len(rows):
            continue
        flat = col.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
        v = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
        ok = (np.abs(v) < _LARGE).all(1)   # false for nan and infinities
        yield rows[ok], np.floor(SCALE * v[ok]).astype(np.int64) + OFFSET


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact y'y. Values so small that a block's sums stay below 2^53 go
    through one product in double precision; others in halves."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    total = 0
    for at in range(0, len(y), 1024):
        part = y[at:at + 1024]
        h, low = (part >> 20).astype(np.float64), (part & ((1 << 20) - 1)).astype(np.float64)
        hh, hl, ll = ((a.T @ b).astype(np.int64).astype(object) for a, b in ((h, h), (h, low), (low, low)))
        total = total + hh * (1 << 40) + (hl + hl.T) * (1 << 20) + ll
    return total


def _sums(vec_col: str):
    def run(batches):
        got: dict[int, list] = {}
        for b in batches:
            for rows, x in _usable(column(b, vec_col)):
                if len(rows):
                    n, s = got.get(x.shape[1], (0, 0))
                    got[x.shape[1]] = n + len(rows), s + x.sum(0).astype(object)
        for d, (n, s) in got.items():
            yield pa.record_batch({"dim": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                                   "n": pa.array([n] * d, pa.int64()), "s": pa.array(s.tolist(), _DEC)})
    return run


def _products(vec_col: str, shift: np.ndarray):
    def run(batches):
        total = 0
        for b in batches:
            for rows, x in _usable(column(b, vec_col), len(shift)):
                if len(rows):
                    total = total + _gram(x - shift)
        if not isinstance(total, int):
            d = len(shift)
            i, j = np.triu_indices(d)
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                   "v": pa.array(total[i, j].tolist(), _DEC)})
    return run


@dataclass
class Whitener:
    n: int                   # vectors of the fit list
    shift: np.ndarray        # integer nearest each mean
    rest: np.ndarray         # n * mean - n * shift, integers
    values: np.ndarray       # leading eigenvalues, falling
    vectors: np.ndarray      # dim x components, unit columns
    trace: float


def fit(vectors: DataFrame, k: int = 8, vec_col: str = "embedding") -> Whitener | None:
    """Covariance of all usable vectors and its first ``k`` components. The
    driver gets dimension sums and dimension^2 / 2 products."""
    got = vectors.select(vec_col).mapInArrow(_sums(vec_col), "dim int, i int, n long, s decimal(38,0)")
    got = got.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not got:
        return None
    n, dim = max((r["n"], -r["dim"]) for r in got)
    dim = -dim
    total = [int(r["s"]) for r in sorted((r for r in got if r["dim"] == dim), key=lambda r: r["i"])]
    shift = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * a for s, a in zip(total, shift)]
    prod = vectors.select(vec_col).mapInArrow(_products(vec_col, np.array(shift, np.int64)), "i int, j int, v decimal(38,0)")
    v = np.zeros((dim, dim))
    for r in prod.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["v"]) - rest[i] * rest[j]) / (n * n)   # integers, divided once
    values, basis = leading(v, k)
    return Whitener(n, np.array(shift, np.int64), np.array(rest, object), values, basis, float(np.trace(v)))


def _project(id_col: str, vec_col: str, w: Whitener, id_type):
    mean = np.array([float(r) / w.n for r in w.rest])
    turn = w.vectors / np.sqrt(w.values)
    most_rest = max((abs(int(r)) for r in w.rest), default=0)

    def deviations(y: np.ndarray):
        most = (int(np.abs(y).max(initial=0)) * w.n + most_rest) ** 2 * y.shape[1]
        if most < 1 << 63:
            return pa.array(((y * w.n - w.rest.astype(np.int64)) ** 2).sum(1)).cast(_DEC)
        return pa.array([int(((row * w.n - w.rest) ** 2).sum()) for row in y.astype(object)], _DEC)

    def run(batches):
        for b in batches:
            for rows, x in _usable(column(b, vec_col), len(w.shift)):
                for at in range(0, len(rows), 8192):
                    y = x[at:at + 8192] - w.shift
                    z = (y - mean) @ turn
                    z = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.record_batch({"id": column(b, id_col).take(pa.array(rows[at:at + 8192])),
                                           "deviation": deviations(y), "z": z})
    return run


def whitened(vectors: DataFrame, w: Whitener | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A staged table (id, deviation, z): the exact sum over dimensions of
    (n*x - S)^2 and the projections over sqrt(eigenvalue), for every usable row."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), z array<double>"
    if w is None or not len(w.values):
        return spark.createDataFrame([], schema)
    pair = vectors.select(id_col, vec_col)
    return stage(pair.mapInArrow(_project(id_col, vec_col, w, kind), schema))


def identity_error(z: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``z`` (array of ``k``)
    minus the identity; means first, then centred products."""
    if not k:
        return 0.0
    mean = z.agg(*[F.avg(F.col("z")[i]) for i in range(k)]).first()
    if mean[0] is None:
        return 0.0
    c = [F.col("z")[i] - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = z.agg(*[F.avg(c[i] * c[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, got))


def components(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Fit and apply: one row per usable vector and component (id column,
    component from 1, n, deviation as decimal, whitened, explained, identity_error)."""
    w = fit(vectors, k, vec_col)
    z = whitened(vectors, w, id_col, vec_col)
    m = 0 if w is None else len(w.values)
    err = identity_error(z, m)
    shares = F.array(*[F.lit(float(e) / w.trace) for e in w.values]) if m else F.array().cast("array<double>")
    got = z.select(F.col("id").alias(id_col), "deviation", F.posexplode("z").alias("i", "whitened"))
    return got.select(id_col, (F.col("i") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"),
                      "deviation", "whitened", F.try_element_at(shares, F.col("i") + 1).alias("explained"),
                      F.lit(err).alias("identity_error"))


# ------------------------------------------------------------------ FEAST

def inertia(a: np.ndarray) -> tuple[int, int]:
    """(negative, positive) eigenvalues of a symmetric matrix: the signs in
    an LDL' factorisation with 1x1 and 2x2 pivots (Bunch-Kaufman, the whole
    remaining diagonal searched)."""
    a = a.copy()
    alpha, neg, pos = (1 + np.sqrt(17)) / 8, 0, 0
    while len(a):
        n = len(a)
        d = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        p = int(d.argmax())
        most = off.max() if n > 1 else 0.0
        if d[p] == 0 and most == 0:
            break
        if d[p] >= alpha * most:
            keep = np.delete(np.arange(n), p)
            neg, pos = neg + (a[p, p] < 0), pos + (a[p, p] > 0)
            a = a[np.ix_(keep, keep)] - np.outer(a[keep, p], a[p, keep] / a[p, p])
        else:
            i, j = np.unravel_index(off.argmax(), off.shape)
            keep = np.delete(np.arange(n), [i, j])
            block = a[np.ix_([i, j], [i, j])]
            neg, pos = neg + 1, pos + 1     # its determinant is negative
            b = a[np.ix_(keep, [i, j])]
            a = a[np.ix_(keep, keep)] - b @ np.linalg.solve(block, b.T)
    return int(neg), int(pos)


def above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues are above ``s``."""
    return inertia(v - s * np.eye(len(v)))[1]


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 1, rounds: int = 60):
    """The ``count`` eigenpairs of ``v`` in (low, high), falling."""
    dim = len(v)
    m = min(dim, count + max(8, count // 2))
    y = np.random.default_rng(seed).normal(size=(dim, m))
    centre, radius = (low + high) / 2, (high - low) / 2
    x, weight = np.polynomial.legendre.leggauss(_NODES)
    ring = radius * np.exp(0.5j * np.pi * (x + 1))
    norm = np.abs(v).sum(1).max()
    for _ in range(rounds):
        q = np.zeros((dim, m))
        for z, wt in zip(ring, weight):     # the lower half circle is the conjugate
            q += 0.5 * wt * (z * np.linalg.solve((centre + z) * np.eye(dim) - v, y.astype(complex))).real
        q, _ = np.linalg.qr(q)
        h = q.T @ v @ q
        e, u = np.linalg.eigh((h + h.T) / 2)   # Rayleigh-Ritz in the projected space
        e, y = e[::-1], q @ u[:, ::-1]
        inside = np.flatnonzero((e > low) & (e < high))
        if len(inside) == count:
            error = np.linalg.norm(v @ y[:, inside] - y[:, inside] * e[inside], axis=0).max()
            if error <= 4 * dim * np.finfo(float).eps * norm:
                return e[inside], y[:, inside]
    raise ArithmeticError(f"contour integrals found {len(inside)} of {count} eigenvalues in ({low}, {high})")


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` eigenpairs (fewer if fewer eigenvalues are above
    rounding level). An interval that holds them, and few others, is bisected
    by inertia counts."""
    dim, none = len(v), (np.zeros(0), np.zeros((len(v), 0)))
    top = np.abs(v).sum(1).max(initial=0.0)
    if top <= 0 or not np.isfinite(top):
        return none
    a = v / top
    floor = 4 * dim * np.finfo(float).eps
    low, high, count = floor, 1.0 + 1e-9, above(a, floor)
    k = min(k, count)
    if not k:
        return none
    least = high
    for _ in range(60):
        if count <= k + 8:
            break
        mid = (low + least) / 2
        got = above(a, mid)
        if got >= k:
            low, count = mid, got
        else:
            least = mid
    e, y = feast(a, low, high, count)
    return e[:k] * top, y[:, :k]
