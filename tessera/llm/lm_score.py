"""Language-model scoring by masked pseudo-likelihood.

A small network reads the two words on each side of a position (the word
itself is hidden) and predicts the word: a softmax over word classes, then
the word's share of its class. A document's score is the sum of the log
probabilities of all its words. Word counts cover the whole corpus, and so does
training: every position of every document is trained on once. The documents
are dealt to rounds; in each, tasks train numpy copies of the network on their
documents of that round and the copies are averaged, weighted by positions.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, buffers, column, mix, partitions, slices, stage, word_hashes

WINDOW = 2      # words read on each side
RARE = 64       # hash groups of words outside the vocabulary, a power of two
DIM, HIDDEN, CLASSES = 16, 32, 64
SHUFFLED = 1 << 16  # positions of neighbouring documents in a task that are trained on in mixed order


@dataclass
class Vocabulary:
    words: np.ndarray      # sorted hashes of the most frequent words
    kind: np.ndarray       # class of each token (words, then rare groups)
    within: np.ndarray     # log share of a token in its class

    @property
    def pad(self) -> int:
        return len(self.kind)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        rare = len(self.words) + (h % U64(RARE)).astype(np.int64)
        if not len(self.words):
            return rare
        at = np.searchsorted(self.words, h).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == h, at, rare)


def vocabulary(docs: DataFrame, size: int = 8192, text_col: str = "text") -> Vocabulary:
    """Counts of all words of all documents; the ``size`` most frequent (ties
    to the smaller hash) are tokens of their own. Classes are runs of the
    tokens by frequency that hold about equal shares of the text."""
    def run(batches):
        for batch in slices(batches, text_col, 1 << 22):
            h, _ = word_hashes(*buffers(column(batch, text_col)))
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = stage(docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "h").limit(size).toArrow()  # at most ``size`` rows
    words, n = top["h"].to_numpy().view(U64), top["n"].to_numpy().astype(float)
    chosen = stage(docs.sparkSession.createDataFrame([(int(w),) for w in words.view(np.int64)], "h long"))
    group = F.col("h").bitwiseAND(RARE - 1)  # the unsigned remainder, as in tokens()
    rest = counts.join(F.broadcast(chosen), "h", "left_anti").groupBy(group.alias("g")).agg(F.sum("n").alias("n"))
    rare = np.ones(RARE)
    for r in rest.collect():  # RARE rows
        rare[r["g"]] += float(r["n"])
    o = np.argsort(words)
    n = np.concatenate([n[o], rare])
    by = np.argsort(-n, kind="stable")
    kind = np.empty(len(n), np.int64)
    kind[by] = np.minimum((np.cumsum(n[by]) - n[by]) * CLASSES // n.sum(), CLASSES - 1)
    return Vocabulary(words[o], kind, np.log(n / np.bincount(kind, n, CLASSES)[kind]))


@dataclass
class Network:
    emb: np.ndarray   # (tokens + padding) x DIM
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, tokens: int) -> Network:
        r = np.random.default_rng(5)

        def make(*shape, scale):
            return (r.normal(size=shape) * scale).astype(np.float32)
        return cls(make(tokens + 1, DIM, scale=0.3), make(2 * WINDOW * DIM, HIDDEN, scale=0.12),
                   np.zeros(HIDDEN, np.float32), make(HIDDEN, CLASSES, scale=0.18), np.zeros(CLASSES, np.float32))

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.take(self.emb, ctx.reshape(-1), axis=0).reshape(len(ctx), -1)
        h = x @ self.w1
        h += self.b1
        return x, np.tanh(h, out=h)

    def log_class(self, ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log probability of class ``y`` between the words of ``ctx``."""
        z = self.hidden(ctx)[1] @ self.w2 + self.b2
        z -= z.max(1, keepdims=True)
        return z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))

    def train(self, ctx: np.ndarray, y: np.ndarray, rate: float, batch: int = 128) -> None:
        """One pass of stochastic gradient steps in the order given."""
        small = np.uint16 if len(self.emb) <= 1 << 16 else np.int64  # 16 bits sort in one pass
        for a in range(0, len(y), batch):
            c, t = ctx[a:a + batch], y[a:a + batch]
            x, h = self.hidden(c)
            z = h @ self.w2
            z += self.b2
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z *= (rate / len(t)) / z.sum(1, keepdims=True)
            z[np.arange(len(t)), t] -= np.float32(rate / len(t))
            dh = z @ self.w2.T
            dh *= 1 - h * h
            dx = dh @ self.w1.T
            self.w2 -= h.T @ z
            self.b2 -= z.sum(0)
            self.w1 -= x.T @ dh
            self.b1 -= dh.sum(0)
            token = c.reshape(-1).astype(small)
            o = np.argsort(token, kind="stable")
            token = token[o]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            self.emb[token[first]] -= np.add.reduceat(np.take(dx.reshape(-1, DIM), o, axis=0), first)

    def parts(self) -> list[np.ndarray]:
        return [self.emb, self.w1, self.b1, self.w2, self.b2]


def contexts(tok: np.ndarray, off: np.ndarray, pad: int, at: np.ndarray | None = None) -> np.ndarray:
    """Tokens around each position (``at``: some of them), padding beyond the
    document's ends."""
    at = np.arange(len(tok)) if at is None else at
    doc = np.searchsorted(off, at, "right") - 1
    out = np.empty((len(at), 2 * WINDOW), np.int64)
    for k, d in enumerate([d for d in range(-WINDOW, WINDOW + 1) if d]):
        p = at + d
        ok = (p >= off[doc]) & (p < off[doc + 1])
        out[:, k] = np.where(ok, tok[p.clip(0, max(len(tok) - 1, 0))], pad)
    return out


def _kind(vocab: Vocabulary):
    """Numbers that hold every token."""
    return np.uint16 if vocab.pad < 1 << 16 else np.int32


def token_rows(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(key, n, t) per document: a hash of id and text, the number of its
    words, their tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # at most ``size`` words

    def run(batches):
        v = shared.value
        for batch in slices(batches, text_col, 1 << 21):
            h, off = word_hashes(*buffers(column(batch, text_col)))
            tok = v.tokens(h).astype(_kind(v))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), pa.array(np.diff(off).astype(np.int64)),
                 pa.array([tok[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())],
                names=["key", "n", "t"])

    return docs.select(F.xxhash64(id_col, text_col).alias("key"), text_col).mapInArrow(run, "key long, n long, t binary")


def positions(batches, vocab: Vocabulary, one_in: int):
    """(contexts, classes) of the positions of token rows, those of about
    ``SHUFFLED`` at a time in mixed order. All positions, or with ``one_in``
    above 1 those that a hash of the word and its place chooses."""
    for batch in batches:
        n, t = column(batch, "n").to_numpy(), column(batch, "t")
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            done = ends[at] - n[at]
            end = max(at + 1, int(np.searchsorted(ends, done + SHUFFLED, "right")))
            off = np.append(done, ends[at:end]) - done
            tok = np.frombuffer(b"".join(v.as_py() for v in t[at:end]), _kind(vocab)).astype(np.int64)
            spot = np.arange(len(tok))
            if one_in > 1:
                place = spot - np.repeat(off[:-1], np.diff(off))
                spot = spot[mix(tok.astype(U64) + place.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(one_in) == 0]
            spot = np.random.default_rng(5).permutation(spot)
            for a in range(0, len(spot), SHUFFLED):
                part = spot[a:a + SHUFFLED]
                yield contexts(tok, off, vocab.pad, part), vocab.kind[tok[part]]
            at = end


def fit(docs: DataFrame, size: int = 8192, one_in: int = 1, rounds: int = 3, rate: float = 0.4, text_col: str = "text",
        id_col: str = "doc_id") -> tuple[Vocabulary, Network]:
    """Vocabulary and network of ``docs``, from all their positions (unless
    ``one_in`` is above 1). Documents are dealt to ``rounds`` and to tasks by
    a hash of id and text. Each round, every task trains a copy; copies are
    summed in about the square root of that many groups, then on the driver,
    which sees as many copies."""
    vocab = vocabulary(docs, size, text_col)
    net = Network.new(vocab.pad)
    rows = stage(token_rows(docs, vocab, id_col, text_col))
    words = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, min(partitions(docs.sparkSession), words // max(rounds, 1) // SHUFFLED))
    for k in range(rounds):
        # in an order that no file sets
        mine = rows.where((F.col("n") > 0) & (F.pmod("key", F.lit(rounds)) == k)).repartition(parts, "key")
        net = _round(mine.sortWithinPartitions("key", "t"), vocab, net, rate / (1 + k), one_in, max(1, int(np.sqrt(parts))))
    return vocab, net


def _round(rows: DataFrame, vocab: Vocabulary, net: Network, rate: float, one_in: int, groups: int) -> Network:
    shared = rows.sparkSession.sparkContext.broadcast((vocab, net))

    def train(batches):
        v, own = shared.value
        own = pickle.loads(pickle.dumps(own))
        n = 0
        for c, y in positions(batches, v, one_in):
            own.train(c, y, rate)
            n += len(y)
        if n:
            w = pickle.dumps([p.astype(np.float64) * n for p in own.parts()])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w], pa.binary())], names=["n", "w"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        total = None
        for i in order.tolist():
            w = pickle.loads(table["w"][i].as_py())
            total = w if total is None else [a + b for a, b in zip(total, w, strict=True)]
        return pa.table({"n": pa.array([int(table["n"].to_numpy().sum())], pa.int64()),
                         "w": pa.array([pickle.dumps(total)], pa.binary())})

    copies = rows.select("n", "t").mapInArrow(train, "n long, w binary")
    got = copies.groupBy(F.pmod(F.xxhash64("w"), F.lit(groups)).alias("g")).applyInArrow(add, "n long, w binary").collect()
    if not got:
        return net
    got = sorted(got, key=lambda r: (r["n"], bytes(r["w"])))
    total = sum(r["n"] for r in got)
    parts = [pickle.loads(bytes(r["w"])) for r in got]
    return Network(*[(sum(p[i] for p in parts) / total).astype(np.float32) for i in range(5)])


def score(docs: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob) per row over the whole text.
    Null and empty texts have no tokens: log_prob 0 and a null mean. Repeated
    rows score alike; other columns are not read."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()),
                           T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def run(batches):
        v, m = shared.value
        for batch in slices(batches, text_col, 1 << 20):
            h, off = word_hashes(*buffers(column(batch, text_col)))
            tok = v.tokens(h)
            lp = np.empty(len(tok))
            for a in range(0, len(tok), 8192):
                at = np.arange(a, min(a + 8192, len(tok)))
                t = tok[at]
                lp[at] = m.log_class(contexts(tok, off, v.pad, at), v.kind[t]) + v.within[t]
            total = np.concatenate([[0.0], np.cumsum(lp)])
            n = np.diff(off)
            s = total[off[1:]] - total[off[:-1]]
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col), pa.array(n.astype(np.int64)), pa.array(s),
                 pa.array(s / np.maximum(n, 1), mask=n == 0)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
