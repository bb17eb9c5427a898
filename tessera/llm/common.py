"""Helpers shared by the operators: staged tables in the cluster's shared
folder, Arrow text slicing, vectorised word hashing and connected
components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

U64 = np.uint64


# ----------------------------------------------------------------- tables

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table below ``spark.checkpoint.dir`` and read
    it again: lineage is cut and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tessera-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stage` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera-llm/" in path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_FILTER_WORDS = 1 << 17


def holding(df: DataFrame, id_col: str, ids: DataFrame, hit: bool = True) -> DataFrame:
    """Rows of ``df`` whose id may be among ``ids`` (its first column), or
    with ``hit=False`` the others: a bit filter of fixed size (2 MB) goes to
    every task, so that most rows without a partner never reach a shuffle.
    The kept rows still need the exact join."""
    def spot(col):
        return F.pmod(F.xxhash64(col), F.lit(_FILTER_WORDS)), F.pmod(F.xxhash64(col, F.lit(1)), F.lit(64)).cast("int")

    word, bit = spot(ids[ids.columns[0]].cast("long"))
    bits = ids.select(word.alias("_word"), bit.alias("_b")).groupBy("_word").agg(
        F.expr("bit_or(shiftleft(1L, _b))").alias("_bits"))  # at most _FILTER_WORDS rows
    word, bit = spot(F.col(id_col).cast("long"))
    got = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    return got.where(F.expr("coalesce(bit_get(_bits, _bit), 0)") == int(hit)).select(*df.columns)


def free_name(name: str, taken) -> str:
    """``name`` with as many leading underscores as it takes to differ from
    all ``taken`` names (Spark does not tell case apart)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


# ------------------------------------------------------------ arrow texts

def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batches, text: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of text (or
    one longer text): numpy work arrays stay bounded. No row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = buffers(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


# ----------------------------------------------------------- word hashing

_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TAB = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = _TAB.copy()
_LOW[65:91] = _TAB[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_BLOCK = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_P, _PINV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POW[i] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                tab: np.ndarray = _LOW) -> np.ndarray:
    """Hashes of data[start:end] for many spans from one prefix sum."""
    if not len(starts):
        return np.zeros(0, U64)
    pw, inv = _powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    np.cumsum(tab[data] * pw[: len(data)], out=h[1:])
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(U64))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts."""
    w = ~_SPACE[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] = w[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, off: np.ndarray, tab: np.ndarray = _LOW):
    """Hash of every word (A-Z lower-cased) and word offsets per text. Very
    long inputs go in blocks that end between words."""
    out, counts_at, at = [], [], 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data):
            cut = np.searchsorted(off, end)
            edge = int(off[cut])
            sp = np.flatnonzero(_SPACE[data[end:edge]][: _BLOCK])
            end = end + int(sp[0]) if len(sp) else edge
        part = data[at:end]
        lo, hi = np.searchsorted(off, [at, end])
        inner = np.unique(np.concatenate([[at], off[lo:hi + 1].clip(at, end), [end]])) - at
        s, e = word_spans(part, inner)
        out.append(span_hashes(part, s, e, tab))
        counts_at.append(s + at)
        at = end
    if not out:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    where = np.concatenate(counts_at)
    return np.concatenate(out), np.searchsorted(where, off, "left")


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the ``n``-word shingles of one text, sorted; with
    fewer words, the whole sequence as one; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    m = len(words) - k + 1
    h = np.full(m, k, U64)
    for i in range(k):
        h = h * _P + words[i:i + m]
    return np.unique(mix(h))


# ------------------------------------------------- connected components

_ROWS_PER_FILE = 100_000

def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, comp), comp the least
    node reachable. Alternating large-star and small-star steps, each a
    partially aggregated minimum and a join whose hot keys Spark can split;
    the result of each, and what is returned, is a staged table. Empty input
    gives no rows."""
    cur = stage(edges.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # no step makes more than two rows of a link: as many files as its rows need, at least 8
    files = max(8, 2 * cur.count() // _ROWS_PER_FILE + 1)

    def step(df: DataFrame) -> DataFrame:
        return stage(df.coalesce(files) if files < partitions(df.sparkSession) else df)

    while True:
        # done once every node is a centre or has one link, to a centre
        seen = cur.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            cur.select("v", F.lit(0), F.lit(1)))
        seen = seen.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if seen.where("up + down > 1").isEmpty():
            return step(cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = step(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = step(large.join(low, "u").where("v <> m")
                    .select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(low.select("u", F.col("m").alias("v"))).distinct())
