"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are rotated by one random orthogonal matrix, so that a prefix of the
dimensions estimates the whole distance. An inverted file of k-means lists
(centres fitted on a bounded sample, every row indexed) gives each query the
lists to probe. Within a list the rotated columns are read in blocks; after
each block a hypothesis test on the partial distance abandons candidates
that can hardly come below the query's k-th distance so far. Survivors are
measured exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, stage

CHUNK = 8192      # candidates in one task's group, about
QUERY_BLOCK = 64  # queries scanned together


@dataclass
class Index:
    rotation: np.ndarray   # dim x dim
    centres: np.ndarray    # lists x dim, rotated
    shift: np.ndarray      # mean of the sample, taken off before rotating
    probes: int = 1        # lists that hold the aimed share of neighbours

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) @ self.rotation

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each rotated vector."""
        d = (self.centres ** 2).sum(1) - 2 * x @ self.centres.T
        n = min(n, len(self.centres))
        if n == 1:
            return d.argmin(1)[:, None]
        if n < d.shape[1]:
            top = np.argpartition(d, n - 1, axis=1)[:, :n]
            return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)
        return np.argsort(d, axis=1, kind="stable")


def matrix(col, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows usable, their vectors in double precision): not null, ``dim``
    long (by default the most frequent length, the smaller in a tie), finite
    in every component and not zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
    dim = int(np.bincount(size[size > 0], minlength=1).argmax()) if dim is None else dim
    rows = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    if not len(rows):
        return rows, np.zeros((0, dim or 0))
    flat = col.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


def fit(vectors: DataFrame, max_train: int = 8192, lists: int | None = None, id_col: str = "vec_id",
        vec_col: str = "embedding", rounds: int = 8, recall: float = 0.985, k: int = 10) -> Index | None:
    """Rotation and centres from the ``max_train`` rows of least hashed id;
    lists default to the square root of the rows, at most ``max_train`` / 16.
    ``probes`` is set by measurement: the number of lists that hold ``recall``
    of the sample's true ``k`` nearest neighbours, for 256 rows of the sample
    compared with all of it. None without usable vectors."""
    n = vectors.count()
    sample = vectors.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(max_train).toArrow()
    rows, x = matrix(sample[vec_col])
    if not len(rows):
        return None
    ids = sample[id_col].to_numpy(zero_copy_only=False)[rows]
    x = x[np.argsort(ids, kind="stable")]
    rng = np.random.default_rng(7)
    q, r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    shift = x.mean(0)
    x = (x - shift) @ (q * np.sign(np.diag(r)))
    k = lists or max(1, min(int(np.sqrt(n)), max_train // 16))
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    index = Index(q * np.sign(np.diag(r)), centres, shift)
    asked = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    d = (asked ** 2).sum(1)[:, None] + (x ** 2).sum(1) - 2 * asked @ x.T
    true = np.argsort(d, axis=1, kind="stable")[:, 1:k + 1]
    home = index.lists(x, 1)[:, 0]
    place = np.argsort(index.lists(asked, len(centres)), axis=1)
    ranks = np.take_along_axis(place, home[true], 1)
    index.probes = int(np.quantile(ranks, recall, method="higher")) + 1 if ranks.size else 1
    return index


def scan(q: np.ndarray, qr: np.ndarray, x: np.ndarray, xr: np.ndarray, k: int, same: np.ndarray,
         ids: np.ndarray, block: int = 16, sigmas: float = 4.0):
    """Nearest ``k`` rows of ``x`` for each query (arrays of query, row and
    exact distance). ``q``/``x`` original, ``qr``/``xr`` rotated vectors;
    ``same`` marks pairs that are one row. Ties go to the smaller id."""
    m, n, dim = len(q), len(x), x.shape[1]
    alive = ~same
    limit = np.full(m, np.inf)
    if n > 4 * k:  # a first bound from a few candidates near in the first block
        first = ((qr[:, None, :block] - xr[None, :, :block]) ** 2).sum(2) if m * n * block < 1 << 24 else \
            (qr[:, :block] ** 2).sum(1)[:, None] + (xr[:, :block] ** 2).sum(1) - 2 * qr[:, :block] @ xr[:, :block].T
        first = np.where(alive, first, np.inf)
        seed = np.argpartition(first, k, axis=1)[:, :k + 1]
        for i in range(m):
            s = seed[i][alive[i, seed[i]]]
            if len(s) >= k:
                limit[i] = np.partition(((x[s] - q[i]) ** 2).sum(1), k - 1)[k - 1]
    part = np.zeros((m, n))
    for a in range(0, dim, block):
        b = min(a + block, dim)
        part += (qr[:, a:b] ** 2).sum(1)[:, None] + (xr[:, a:b] ** 2).sum(1) - 2 * qr[:, a:b] @ xr[:, a:b].T
        if b == dim:
            alive &= part <= limit[:, None] * (1 + 1e-9) + 1e-9
        else:  # accept that d^2 > limit when the partial sum is this far above its share
            alive &= part <= limit[:, None] * (b / dim) * (1 + sigmas * np.sqrt(2 * (1 / b - 1 / dim)) / 2) ** 2 + 1e-12
        cols = np.flatnonzero(alive.any(0))
        if len(cols) < 0.7 * part.shape[1] and b < dim:  # abandoned by every query
            part, alive, x, xr, ids = part[:, cols], alive[:, cols], x[cols], xr[cols], ids[cols]
    out_q, out_id, out_d = [], [], []
    for i in range(m):
        c = np.flatnonzero(alive[i])
        d = np.sqrt(((x[c] - q[i]) ** 2).sum(1))
        o = np.lexsort((ids[c], d))[:k]
        out_q.append(np.full(len(o), i))
        out_id.append(ids[c[o]])
        out_d.append(d[o])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def search(vectors: DataFrame, queries: DataFrame, index: Index | None, k: int = 10, probes: int | None = None,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every usable row of ``queries``
    its ``k`` nearest found rows of ``vectors`` other than itself, by
    Euclidean distance, ties to the smaller id. A query whose probed lists
    hold fewer than ``k`` candidates is searched again over all lists;
    ``probes`` defaults to what :func:`fit` measured.

    Candidates go to (list, chunk) groups of about ``CHUNK`` rows, so that a
    list that holds a third of all rows is scanned in many tasks; a query
    goes to every chunk of its lists. Rows without an id, and vectors that
    are null, zero, of another length or hold null or non-finite components,
    take no part. Equal rows count one by one; a query leaves out rows of its
    own id."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    final = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], final)
    probes = probes or index.probes
    shared = spark.sparkContext.broadcast(index)  # dim^2 + lists x dim numbers, bounded by the sample
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("list", T.IntegerType()),
                        T.StructField("v", T.ArrayType(T.DoubleType()))])

    def assign(n: int):
        def run(batches):
            ix = shared.value
            dim = ix.centres.shape[1]
            for batch in batches:
                rows, x = matrix(column(batch, "v"), dim)
                near = ix.lists(ix.rotate(x), n) if len(rows) else np.zeros((0, 1), np.int64)
                w = near.shape[1]
                ids = column(batch, "id").take(pa.array(np.repeat(rows, w)))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) * w + 1) * dim, pa.int32()),
                                             pa.array(np.repeat(x, w, axis=0).reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.reshape(-1).astype(np.int32)), v],
                                                 names=["id", "list", "v"])
        return run

    def placed(df: DataFrame, n: int) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(
            "id is not null").mapInArrow(assign(n), row)

    def probe(asked: DataFrame, base: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
        q = (placed(asked, n).join(sizes, "list")
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
        q = q.select("list", "chunk", "id", "v", F.lit(True).alias("ask"))
        return (q.groupBy("list", "chunk").cogroup(base.groupBy("list", "chunk"))
                .applyInArrow(_scan_group(shared, k), out))

    base = placed(vectors, 1)
    sizes = stage(base.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    base = base.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "v")

    def best(found: DataFrame) -> DataFrame:
        near = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)

    found = stage(best(probe(queries, base, sizes, probes)))
    if probes >= len(index.centres):
        return found.select("query_id", "rank", "vec_id", "score")
    short = (queries.select(F.col(id_col).cast("long").alias(id_col), vec_col).where(F.col(id_col).isNotNull())
             .join(found.where(F.col("rank") == k).select(F.col("query_id").alias(id_col)), id_col, "left_anti"))
    short = stage(short)
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    rest = best(probe(short, base, sizes, len(index.centres)))
    full = found.join(short.select(F.col(id_col).alias("query_id")), "query_id", "left_anti")
    cols = ["query_id", "rank", "vec_id", "score"]
    return full.select(*cols).union(rest.select(*cols))


def _scan_group(shared, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                 "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        ix = shared.value
        _, q = matrix(left["v"])
        _, x = matrix(right["v"])
        qid, ids = left["id"].to_numpy(), right["id"].to_numpy()
        qr, xr = ix.rotate(q), ix.rotate(x)
        got = []
        for a in range(0, len(q), QUERY_BLOCK):
            s = slice(a, a + QUERY_BLOCK)
            i, j, d = scan(q[s], qr[s], x, xr, k, qid[s, None] == ids[None, :], ids)
            got.append((qid[s][i], j, d))
        i, j, d = (np.concatenate(c) for c in zip(*got, strict=True))
        return pa.table({"query_id": pa.array(i, pa.int64()), "vec_id": pa.array(j, pa.int64()), "score": pa.array(d)})
    return run
