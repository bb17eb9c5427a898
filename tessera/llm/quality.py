"""Quality classifier: logistic regression over hashed word n-grams, trained
with follow-the-regularised-leader (FTRL-proximal) updates; every document
is scored as sparse dot products.

A document's features are its word 1- and 2-grams and the 1-, 2- and 3-grams
of its word forms (each word as the pattern of its letter cases, digits and
signs, and whether it repeats the word before), hashed into 2^``bits``
weights. Each of the five groups sums to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, buffers, column, free_name, mix, slices, span_hashes, word_spans

GROUPS = ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3))  # (stream, n)

_FORM = np.arange(256, dtype=np.uint8)
_FORM[48:58] = ord("9")
_FORM[65:91] = ord("X")
_FORM[97:123] = ord("x")
_FORM[128:] = ord("x")


def streams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word-form hashes and word offsets of each text."""
    s, e = word_spans(data, off)
    literal = span_hashes(data, s, e)
    form = _FORM[data]
    keep = np.ones(len(form), bool)
    keep[1:] = form[1:] != form[:-1]
    keep[s] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    short = form[keep]
    forms = span_hashes(short, at[s], at[e], np.arange(256, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(7))
    word = np.searchsorted(s, off)
    same = np.zeros(len(s), bool)
    same[1:] = literal[1:] == literal[:-1]
    first = word[:-1][word[:-1] < word[1:]]
    same[first] = False
    return literal, mix(forms + same.astype(U64)), word


def grams(data: np.ndarray, off: np.ndarray, bits: int):
    """For each group: feature of the n-gram that starts at each word, and
    for each text the range of words that start one."""
    *flows, word = streams(data, off)
    for g, (k, n) in enumerate(GROUPS):
        w = flows[k]
        h = np.full(max(len(w) - n + 1, 0), g + 1, U64)
        for i in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + w[i:i + len(h)]
        idx = (mix(h) >> U64(64 - bits)).astype(np.int64)
        lo = word[:-1].clip(max=len(h))
        hi = np.maximum(lo, (word[1:] - n + 1).clip(max=len(h)))
        yield idx, lo, hi


@dataclass
class QualityModel:
    bits: int
    bias: float
    weights: np.ndarray

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        for idx, lo, hi in grams(data, off, self.bits):
            c = np.concatenate([[0.0], np.cumsum(self.weights[idx], dtype=np.float64)])
            z += (c[hi] - c[lo]) / np.maximum(hi - lo, 1)
        return 1.0 / (1.0 + np.exp(-z.clip(-50, 50)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int = 3, alpha: float = 0.5,
         beta: float = 0.1, l1: float = 0.01, l2: float = 0.1) -> QualityModel:
    """FTRL-proximal over (features, values, label) rows, in the order given;
    the bias is the last coordinate and is not shrunk to zero."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, x, y in rows:
            w = weight(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -50, 50)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    return QualityModel(bits, float(w[size]), w[:size].astype(np.float32))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, limit: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """At most ``limit`` labelled documents (id, text, y) for which ``keep``
    holds, those of least hashed id; ids and labels are chosen first, so that
    texts of other rows are not moved."""
    lab = labels.select(F.col(id_col), F.col(label).cast("double").alias("y")).where(
        F.col("y").isNotNull() & F.col(id_col).isNotNull()).where(keep).groupBy(id_col).agg(F.max("y").alias("y"))
    ids = (docs.select(id_col).distinct().join(lab, id_col).orderBy(F.xxhash64(id_col), id_col).limit(limit))
    chosen = ids.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most ``limit`` ids
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", max_train: int = 6000, bits: int = 18,
        id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Train on at most ``max_train`` labelled documents (see
    :func:`labelled_sample`); features are made in Spark tasks, updates run
    in order of hashed id. Without labelled rows every score is 0.5."""
    sample = labelled_sample(docs, labels, label, keep, max_train, id_col, text_col)
    schema = "id long, y double, i array<int>, x array<float>"

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            data, off = buffers(column(batch, text_col))
            parts = list(grams(data, off, bits))
            ii, xx = [], []
            for d in range(len(off) - 1):
                i = np.concatenate([idx[lo[d]:hi[d]] for idx, lo, hi in parts])
                v = np.concatenate([np.full(hi[d] - lo[d], 1.0 / max(hi[d] - lo[d], 1)) for _, lo, hi in parts])
                u, inv = np.unique(i, return_inverse=True)
                ii.append(u.astype(np.int32))
                xx.append(np.bincount(inv, v, len(u)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col).cast(pa.int64()), column(batch, "y"), pa.array(ii, pa.list_(pa.int32())),
                 pa.array(xx, pa.list_(pa.float32()))], names=["id", "y", "i", "x"])

    got = sample.mapInArrow(run, schema).toArrow()
    order = np.argsort(mix(got["id"].to_numpy().astype(U64)), kind="stable")
    ii, xx, y = (got[c].combine_chunks() for c in ("i", "x", "y"))
    last = 1 << bits
    rows = [(np.append(ii[int(k)].values.to_numpy(), last), np.append(xx[int(k)].values.to_numpy(), np.float32(1)),
             y[int(k)].as_py()) for k in order]
    if not rows:
        return QualityModel(bits, 0.0, np.zeros(1 << bits, np.float32))
    return ftrl(rows, bits)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
          keep_columns: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """(id, *keep_columns, score) for every row; the whole text counts. The
    score is named ``out``, by default score with underscores on a clash. Null
    and empty texts get the model's bias as score. Repeated rows are scored
    alike, other columns are not read."""
    names = list(dict.fromkeys([id_col, *keep_columns]))
    out = out or free_name("score", names)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights

    def run(batches):
        m = shared.value
        for batch in slices(batches, text_col):
            s = m.score(*buffers(column(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(s)],
                                             names=[*names, out])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, schema)
