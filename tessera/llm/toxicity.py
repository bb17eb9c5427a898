"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted
index with block maxima, distance-weighted votes, calibrated scores and the
examples behind each score.

Terms are words and the first four to seven bytes of words (lower-cased
runs of letters and digits). Every term of the labelled sample is in the
index, none is left out; a term's weight is its idf, raised where the label
is more frequent among the documents that hold it. Documents without any
known term have no direction, hence no neighbours; they get the share of
toxic documents among such examples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm.common import U64, buffers, column, free_name, mix, slices, span_hashes, stage
from tessera.llm.quality import labelled_sample

_OTHER = np.ones(256, bool)
_OTHER[48:58] = _OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False
PREFIXES = (4, 5, 6, 7)
BLOCK = 64  # examples under one maximum
HEAVY = 0.09  # terms in a larger share of the examples are a dense matrix
BATCH = 64  # texts looked up together
RUNS = 1 << 18  # postings whose order is in memory at once
SLICE = 1 << 19  # bytes of text whose terms are in memory at once: some 100 bytes of work arrays a term


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes in text order, their offsets per text and how many equal
    terms each stands for: a prefix as long as the word occurs where the word
    does, so it is counted in the word's weight."""
    flat = np.where(_OTHER[data], np.uint8(32), data)
    s, e = common.word_spans(flat, off)
    size = e - s
    parts = [span_hashes(flat, s, e)]
    parts += [mix(span_hashes(flat, s, np.minimum(s + n, e)) + U64(n)) for n in PREFIXES]
    own = np.stack([np.ones(len(s), bool)] + [size > n for n in PREFIXES], 1)
    many = np.ones(own.shape, np.int8)
    many[:, 0] = len(parts) - own[:, 1:].sum(1)
    count = np.concatenate([[0], np.cumsum(own.sum(1))])
    return np.stack(parts, 1)[own], count[np.searchsorted(s, off)], many[own]


@dataclass
class ToxicityIndex:
    vocabulary: np.ndarray                 # sorted term hashes
    idf: np.ndarray                        # weight of each term
    ids: np.ndarray                        # example ids, examples with a direction
    y: np.ndarray
    level: np.ndarray | None = None        # the amounts that occur; an example's weight of a term is
    by_term: np.ndarray | None = None      # its amount, by a factor of the term
    by_example: np.ndarray | None = None   # and one of the example
    start: np.ndarray | None = None        # postings of each term: examples
    doc: np.ndarray | None = None
    run: np.ndarray | None = None          # runs of equal weight of each term: first postings and places in ``level``
    run_at: np.ndarray | None = None
    weight: np.ndarray | None = None
    heavy: np.ndarray | None = None        # the heavy terms
    column: np.ndarray | None = None       # column of each heavy term, else -1
    held: np.ndarray | None = None         # heavy terms of each example: columns and places in ``level``
    held_column: np.ndarray | None = None
    held_weight: np.ndarray | None = None
    dense: np.ndarray | None = None        # example x heavy term, single precision
    block_max: np.ndarray | None = None    # heavy term x block
    prior: float = 0.0                     # of documents without a term
    base: float = 0.0                      # share of toxic examples
    curve: tuple = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    k: int = 16

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector from the term positions of one text."""
        t, n = np.unique(found, return_counts=True)
        w = np.log1p(n) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def vectors(self, row: np.ndarray, t: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """Weights of unit vectors; row, t, n: texts, terms and counts."""
        w = np.log1p(n) * self.idf[t]
        return w / np.sqrt(np.bincount(row, w * w, rows))[row]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary position of each term, -1 if it is not there."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.vocabulary, hashes).clip(max=len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        none = [np.zeros(0, np.int64)]
        term = np.concatenate(none + [t for t, _ in vectors])
        self.level, place = np.unique(np.concatenate([np.zeros(0)] + [w for _, w in vectors]), return_inverse=True)
        self.by_term, self.by_example = np.ones(len(self.vocabulary)), np.ones(len(self.ids))
        self.place(np.bincount(term, minlength=len(self.vocabulary)),
                   [(np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]), term, place)])
        self.ready()

    def ready(self) -> ToxicityIndex:
        """Make the matrix of the heavy terms, in the task that uses it, and
        the greatest weight of each within a block of examples."""
        if self.dense is None:
            n, wide = len(self.ids), len(self.heavy)
            self.dense = np.zeros((-(-n // BLOCK) * BLOCK, wide), np.float32)
            for a in range(0, n, 4 * BATCH):
                b = min(a + 4 * BATCH, n)
                own = slice(self.held[a], self.held[b])
                row, col = np.repeat(np.arange(a, b), np.diff(self.held[a:b + 1])), self.held_column[own]
                self.dense[row, col] = self.level[self.held_weight[own]] * self.by_term[self.heavy[col]] * self.by_example[row]
            self.block_max = self.dense.reshape(len(self.dense) // BLOCK, BLOCK, wide).max(1).T.astype(float)
        return self

    def place(self, df: np.ndarray, parts) -> None:
        """Postings of all terms from (example, term, place in ``level``)
        parts, one part in memory at a time. The heavy ones are kept by
        example instead. All in the least integers that hold them."""
        n = len(self.ids)
        small, place = np.min_scalar_type(max(n, 1)), np.min_scalar_type(max(len(self.level), 1))
        self.heavy = np.flatnonzero(df > HEAVY * n)
        self.start = np.concatenate([[0], np.cumsum(np.where(df > HEAVY * n, 0, df))])
        self.doc, weights = np.empty(self.start[-1], small), np.empty(self.start[-1], place)
        self.column = np.full(len(df), -1, np.int32)
        self.column[self.heavy] = np.arange(len(self.heavy))
        free = self.start[:-1].copy()
        rest = [(np.zeros(0, small), np.zeros(0, np.int32), np.zeros(0, place))]
        for doc, term, weight in parts:
            col = self.column[term]
            on = col >= 0
            rest.append((doc[on].astype(small), col[on], weight[on].astype(place)))
            doc, term, weight = doc[~on], term[~on], weight[~on]
            o = np.argsort(term, kind="stable")
            t, first, many = np.unique(term[o], return_index=True, return_counts=True)
            at = np.repeat(free[t] - first, many) + np.arange(len(o))
            free[t] += many
            self.doc[at], weights[at] = doc[o], weight[o]
        self._runs(weights)
        doc, col, weight = (np.concatenate(p) for p in zip(*rest, strict=True))
        o = np.argsort(doc, kind="stable")
        self.held = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        self.held_column, self.held_weight = col[o].astype(np.min_scalar_type(max(len(self.heavy), 1))), weight[o]

    def _runs(self, weights: np.ndarray) -> None:
        """Order the postings of each term by weight: a search multiplies
        once for a run of equal ones, most terms have a single run."""
        wide, terms = len(self.level) + 1, len(self.start) - 1
        many, at, a = np.zeros(terms, np.int32), [], 0
        kept = [np.zeros(0, weights.dtype)]
        while a < terms:
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + RUNS, "right")) - 1)
            own = slice(self.start[a], self.start[b])
            key = np.repeat(np.arange(b - a), np.diff(self.start[a:b + 1])) * wide + weights[own]
            o = np.argsort(key, kind="stable")
            self.doc[own], key = self.doc[own][o], key[o]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            many[a:b] = np.bincount(key[first] // wide, minlength=b - a)
            kept.append((key[first] % wide).astype(weights.dtype))
            at.append((first + self.start[a]).astype(np.min_scalar_type(self.start[-1])))
            a = b
        self.run, self.weight = np.concatenate([[0], np.cumsum(many)]).astype(np.int32), np.concatenate(kept)
        self.run_at = np.concatenate([*at, self.start[-1:].astype(np.min_scalar_type(self.start[-1]))])

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`search` for one vector."""
        return self.search(np.array([0, len(t)]), t, w, np.array([skip]))[0]

    def search(self, cut: np.ndarray, t: np.ndarray, w: np.ndarray, skip: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector cut[i]:cut[i + 1] of (t, w), the k examples of
        greatest cosine above 0 except ``skip``, exact. All postings of the
        other terms are added up; then heavy terms are multiplied for the
        blocks whose bound reaches the k-th sum of some vector of the batch.
        That product is in single precision: what comes within 1e-4 of the
        k-th is added up again in double. Ties go to the smaller example id."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.dense)
        scale = np.append(self.by_example, np.zeros(size - len(self.ids)))
        for a in range(0, len(cut) - 1, BATCH):
            b = min(a + BATCH, len(cut) - 1)
            light = np.zeros((b - a, size))
            heavy = np.zeros((b - a, self.dense.shape[1]))
            known, place = np.unique(t[cut[a]:cut[b]], return_inverse=True)  # texts share most terms
            own = [self.doc[x:y] for x, y in zip(self.start[known].tolist(), self.start[known + 1].tolist(), strict=True)]
            for i in range(a, b):
                ti, wi = t[cut[i]:cut[i + 1]], w[cut[i]:cut[i + 1]]
                col = self.column[ti]
                heavy[i - a, col[col >= 0]] = wi[col >= 0]
                ti, wi = ti[col < 0], wi[col < 0]
                if len(ti):
                    at = np.concatenate([own[j] for j in place[cut[i] - cut[a]:cut[i + 1] - cut[a]][col < 0].tolist()])
                    many = self.run[ti + 1] - self.run[ti]
                    r = np.repeat(self.run[ti] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    part = self.level[self.weight[r]] * np.repeat(wi * self.by_term[ti], many)
                    part = np.repeat(part, self.run_at[r + 1] - self.run_at[r])
                    np.multiply(np.bincount(at, part, size), scale, out=light[i - a])
                if skip[i] >= 0:
                    light[i - a, skip[i]] = -9.0
            if not size:
                out += [(np.zeros(0, np.int64), np.zeros(0))] * (b - a)
                continue
            k = min(self.k, size)
            bound = light.reshape(b - a, size // BLOCK, BLOCK).max(2) + heavy @ self.block_max
            least = np.partition(light, size - k, 1)[:, size - k]
            need = (bound >= np.maximum(least, 0)[:, None] - 1e-4).any(0)
            rows = np.flatnonzero(np.repeat(need, BLOCK))
            if need.all():
                near = light + heavy.astype(np.float32) @ self.dense.T
            else:
                near = light[:, rows] + heavy.astype(np.float32) @ self.dense[rows].T
            k = min(k, len(rows))
            for i in range(b - a):
                kth = np.partition(near[i], len(rows) - k)[len(rows) - k] if k else 0.0
                d = rows[near[i] >= max(kth - 1e-4, 1e-9)]
                d = d[d < len(self.ids)]
                s = light[i, d] + self._heavy_sums(heavy[i], d)
                d, s = d[s > 0], s[s > 0]
                o = np.lexsort((self.ids[d], -np.round(s, 12)))[: self.k]
                out.append((d[o], s[o].clip(max=1.0)))
        return out

    def _heavy_sums(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        """What the heavy terms of a vector add for the examples ``d``."""
        lo, many = self.held[d], self.held[d + 1] - self.held[d]
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        part = self.level[self.held_weight[at]] * (w * self.by_term[self.heavy])[self.held_column[at]]
        return np.bincount(np.repeat(np.arange(len(d)), many), part, len(d)) * self.by_example[d]

    def vote(self, d: np.ndarray, s: np.ndarray) -> float:
        """Votes weighted by 1 / (distance + 0.1) and a quarter vote for the
        base rate."""
        w = 1.0 / (1.1 - s)
        return float((w @ self.y[d] + 0.25 * self.base) / (w.sum() + 0.25)) if len(d) else self.prior

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, *self.curve))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step fit of y on x (pool adjacent violators), as points."""
    o = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # [sum y, count, sum x]
    for a, b in zip(x[o].tolist(), y[o].tolist(), strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return (np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1.0) for p in pools]))


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", max_train: int = 12000,
        least_gain: float | None = None, least_odds: float = 4.0, k: int = 16, id_col: str = "doc_id", text_col: str = "text") -> ToxicityIndex:
    """Index at most ``max_train`` labelled documents (those of least hashed
    id) by all their terms. Equal texts (word by word) count once. A term
    weighs idf * log2(1 + odds)^2, with ``odds`` how many times it raises the
    odds of the label (half a document of the base rate on each side; 1 at
    least): one rule at every size and in every language. Only with
    ``least_gain`` are terms left out: those that do not reach this
    log-likelihood ratio and ``least_odds``. The driver holds the index."""
    sample = labelled_sample(docs, labels, label, keep, max_train, id_col, text_col)
    schema = "id long, y double, sign long, t array<long>, n array<int>, m array<byte>"

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            h, at, m = terms(*buffers(column(batch, text_col)))
            tt, nn, mm, sign = [], [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                u, i, n = np.unique(h[a:b], return_index=True, return_counts=True)
                tt.append(u.view(np.int64))
                nn.append(n.astype(np.int32))
                mm.append(m[a:b][i])
                sign.append(int(mix(h[a:b] + np.arange(b - a, dtype=U64) * U64(0x9E3779B97F4A7C15)).sum().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col).cast(pa.int64()), column(batch, "y"), pa.array(sign, pa.int64()),
                 pa.array(tt, pa.list_(pa.int64())), pa.array(nn, pa.list_(pa.int32())), pa.array(mm, pa.list_(pa.int8()))],
                names=["id", "y", "sign", "t", "n", "m"])

    rows = stage(sample.mapInArrow(run, schema).withColumn("r", F.monotonically_increasing_id()))
    first = rows.groupBy("sign").agg(F.min(F.struct("id", "r")).alias("f")).select("f.id", "f.r")
    first = first.groupBy("id").agg(F.min("r").alias("r")).select("r").collect()  # at most ``max_train`` rows
    first = docs.sparkSession.createDataFrame([(x["r"],) for x in first], "r long")
    rows = rows.join(F.broadcast(first), "r")
    total, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    stats = rows.select("y", F.explode(F.arrays_zip("t", "m")).alias("e")).groupBy("e.t").agg(
        F.count("*").cast("double").alias("df"), F.sum("y").alias("a"), F.max("e.m").alias("m")).toArrow()
    vocab, df, a, many = (stats[c].to_numpy() for c in ("t", "df", "a", "m"))
    vocab = vocab.view(U64)
    o = np.argsort(vocab)
    vocab, df, a, many = vocab[o], df[o], a[o], many[o]
    base = pos / max(total, 1)
    odds = (a + base / 2) / (df - a + (1 - base) / 2) * (total - pos) / max(pos, 1e-9) if 0 < pos < total else np.ones(len(vocab))
    idf = (np.log((total + 1) / (df + 1)) + 1) * np.log2(1 + np.maximum(odds, 1)) ** 2 * np.sqrt(many)
    if least_gain is not None:
        good = (_gain(df, a, total, pos) >= least_gain) & (a * (total - pos) >= least_odds * (df - a) * pos)
        vocab, idf, df = vocab[good], idf[good], df[good]
    idx = ToxicityIndex(vocab, idf, np.zeros(0, np.int64), np.zeros(0), base=base, k=k)
    fill_index(idx, rows, df > HEAVY * total)
    return idx


def _gain(df: np.ndarray, a: np.ndarray, total: int, pos: float) -> np.ndarray:
    """Log-likelihood ratio of a term (document frequency df, a of them with
    the label) against independence."""
    e1, e0 = df * pos / max(total, 1), df * (total - pos) / max(total, 1)

    def part(o, e):
        return np.where((o > 0) & (e > 0), o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    return 2 * (part(a, e1) + part(df - a, e0) + part(pos - a, pos - e1)
                + part(total - pos - df + a, total - pos - e0))


def fill_index(idx: ToxicityIndex, rows: DataFrame, common_terms: np.ndarray) -> None:
    """Index the examples ``rows`` with a direction, those that share their
    heaviest common term side by side, and calibrate by leaving one out, in
    Spark tasks. The driver holds terms and counts of the bounded sample
    until it has made the postings; tasks get these only."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((idx.vocabulary, idx.idf, common_terms))

    def place(batches):
        vocabulary, idf, often = shared.value
        ix = ToxicityIndex(vocabulary, idf, np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            top, tt, nn = [], [], []
            for t, n in zip(column(batch, "t"), column(batch, "n"), strict=True):
                at = ix.find(t.values.to_numpy().view(U64))
                n, at = n.values.to_numpy()[at >= 0], at[at >= 0]
                w = np.log1p(n) * ix.idf[at] * often[at]
                top.append(int(at[np.argmax(w)]) if len(w) and w.max() > 0 else -1)
                tt.append(at.astype(np.int32))
                nn.append(n)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "r"), column(batch, "id"), column(batch, "y"), pa.array(top, pa.int32()),
                 pa.array(tt, pa.list_(pa.int32())), pa.array(nn, pa.list_(pa.int32()))],
                names=["r", "id", "y", "top", "t", "n"])

    got = rows.mapInArrow(place, "r long, id long, y double, top int, t array<int>, n array<int>").toArrow()
    shared.destroy()
    size = np.array([0], np.int64)
    if got.num_rows:
        size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in got["t"].chunks])
    r, ids, y, top = (got[c].to_numpy() for c in ("r", "id", "y", "top"))
    some = np.flatnonzero(size[:len(ids)] > 0)
    idx.prior = float((y.sum() - y[some].sum() + idx.base) / (len(ids) - len(some) + 1.0))
    order = np.lexsort((ids[some], top[some]))
    idx.ids, idx.y = ids[some][order], y[some][order]
    rank = np.argsort(order)
    cut = np.concatenate([[0], np.cumsum(size[some])]).astype(np.int64)
    none = [np.zeros(0, np.int32)]
    term = np.concatenate(none + [c.flatten().to_numpy() for c in got["t"].chunks])
    count = np.concatenate(none + [c.flatten().to_numpy() for c in got["n"].chunks])
    del got
    n = len(some)
    found = np.flatnonzero(np.bincount(count))
    code = np.zeros(found[-1] + 1 if len(found) else 1, np.int32)
    code[found] = np.arange(len(found))
    idx.level, idx.by_term, idx.by_example = np.log1p(found), idx.idf, np.zeros(n)

    def part(a, b):
        own, many = slice(cut[a], cut[b]), np.diff(cut[a:b + 1])
        t, c = term[own].astype(np.int64), count[own]
        w = np.log1p(c) * idx.idf[t]
        idx.by_example[rank[a:b]] = 1 / np.sqrt(np.bincount(np.repeat(np.arange(b - a), many), w * w, b - a))
        return np.repeat(rank[a:b], many), t, code[c]

    idx.place(np.bincount(term, minlength=len(idx.vocabulary)),
              (part(a, min(a + 4 * BATCH, n)) for a in range(0, n, 4 * BATCH)))
    del term, count
    if not n:
        return
    shared = spark.sparkContext.broadcast(idx)
    known = np.argsort(r[some])
    numbers = r[some][known]

    def run(batches):
        ix = shared.value.ready()
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                rows, tt, nn = [], [], []
                for r, t, n in zip(*(column(batch.slice(a, BATCH), c) for c in ("r", "t", "n")), strict=True):
                    at = ix.find(t.values.to_numpy().view(U64))
                    if (at >= 0).any():
                        rows.append(r.as_py())
                        tt.append(at[at >= 0])
                        nn.append(n.values.to_numpy()[at >= 0])
                if not rows:
                    continue
                own, size = known[np.searchsorted(numbers, rows)], np.array([len(t) for t in tt])
                t = np.concatenate(tt)
                w = ix.vectors(np.repeat(np.arange(len(rows)), size), t, np.concatenate(nn), len(rows))
                near = ix.search(np.concatenate([[0], np.cumsum(size)]), t, w, rank[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([ix.vote(*x) for x in near]), pa.array([len(d) > 0 for d, _ in near])],
                    names=["own", "v", "hit"])

    got = rows.select("r", "t", "n").mapInArrow(run, "own long, v double, hit boolean").toArrow().sort_by("own")
    shared.destroy()
    hit = got["hit"].to_numpy()
    if hit.any():
        idx.curve = isotonic(got["v"].to_numpy()[hit], idx.y[rank[got["own"].to_numpy()[hit]]])


def score(docs: DataFrame, index: ToxicityIndex, id_col: str = "doc_id", text_col: str = "text",
          keep_columns: tuple[str, ...] = (), evidence: int = 5, out: tuple[str, str] | None = None) -> DataFrame:
    """(id, *keep_columns, score, evidence) for every row, from the whole
    text. The last two are named ``out``, by default score and evidence with
    underscores on a clash. ``evidence``: the nearest examples as (example_id, cosine, label).
    Null and empty texts have no term: score ``index.prior``, no evidence.
    The index is broadcast; its size is bounded by the fitted sample."""
    names = list(dict.fromkeys([id_col, *keep_columns]))
    item = T.StructType([T.StructField("example_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
                         T.StructField("label", T.IntegerType())])
    out = out or [free_name(c, names) for c in ("score", "evidence")]
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.ArrayType(item))])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    arrow = pa.list_(pa.struct([("example_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    most = SLICE

    def run(batches):
        ix = shared.value.ready()
        for batch in slices(batches, text_col, most):
            h, at, _ = terms(*buffers(column(batch, text_col)))
            u, back = np.unique(h, return_inverse=True)
            found = ix.find(u)[back]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            on, wide = found >= 0, max(len(ix.vocabulary), 1)
            key, n = np.unique(row[on] * wide + found[on], return_counts=True)
            row, t = key // wide, key % wide
            rows, cut = np.unique(row, return_index=True)
            near = ix.search(np.append(cut, len(row)), t, ix.vectors(row, t, n, batch.num_rows), np.full(len(rows), -1))
            s = np.full(batch.num_rows, ix.prior)
            why: list[list] = [[] for _ in range(batch.num_rows)]
            for r, (d, c) in zip(rows.tolist(), near, strict=True):
                s[r] = ix.calibrated(ix.vote(d, c)) if len(d) else ix.prior
                why[r] = [{"example_id": int(ix.ids[i]), "cosine": float(x), "label": int(ix.y[i])}
                          for i, x in zip(d[:evidence], c[:evidence], strict=True)]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(s), pa.array(why, arrow)],
                                             names=[*names, *out])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, schema)
