"""Packing documents into fixed-length sequences by shortest-pack-first over
the length histogram.

1. Every document is tokenised once; its ids (closed by ``end_id``) are cut
   at each ``seq_len`` ids, and the pieces' spans are staged.
2. Lengths go longest first into the least filled pattern that still has
   room; only counts of patterns change, so the driver sees the histogram
   (at most ``seq_len`` rows) and at most 2 x ``seq_len`` patterns.
3. Pieces get a rank within their length (salted, so a length that holds a
   third of all pieces is ranked in many tasks) and find their slot by rank.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, slices, stage

_RANK_GROUP = 1 << 17  # pieces ranked in one task, about


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, end_of_text: int):
    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": end_of_text})


def encode(ranks_path: str, text: str | None, end_of_text: int = 50256) -> list[int]:
    """Ids of a byte-level BPE vocabulary without added special tokens; as in
    the tokenizers library, the end-of-text string in a text is its one id."""
    enc = _encoder(ranks_path, end_of_text)
    if not text:
        return []
    if "<|endoftext|>" in text:
        return enc.encode(text, allowed_special="all")
    return enc.encode_ordinary(text)


def pieces(docs: DataFrame, ranks_path: str, seq_len: int = 2048, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens (and
    ``ids`` on request). Null text is an empty document: its only id is
    ``end_id``. Ids may be null or repeated."""
    fields = [docs.schema[id_col]] + [T.StructField(c, T.LongType()) for c in
                                      ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            texts = column(batch, text_col).to_pylist()
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for k, t in enumerate(texts):
                a = np.array(encode(ranks_path, t) + [end_id], "<u4")
                for s in range(0, len(a), seq_len):
                    p = a[s:s + seq_len]
                    row.append(k)
                    start.append(s)
                    length.append(len(p))
                    crc.append(zlib.crc32(p.tobytes()))
                    total.append(len(a))
                    if with_ids:
                        ids.append(p.astype(np.int32))
            cols = [column(batch, id_col).take(pa.array(row, pa.int32()))]
            cols += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def pack_histogram(histogram: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many sequences) from {length: count}: longest
    lengths first, each into the least filled patterns with room for it."""
    open_: list[list] = [[] for _ in range(seq_len + 1)]  # by fill: [pattern, count]
    for length in range(seq_len, 0, -1):
        left = histogram.get(length, 0)
        fill = 0
        while left:
            while fill + length <= seq_len and not open_[fill]:
                fill += 1
            if fill + length > seq_len:
                open_[length].append([(length,), left])
                break
            pattern, count = open_[fill][-1]
            k = min(left, count)
            if k == count:
                open_[fill].pop()
            else:
                open_[fill][-1][1] -= k
            open_[fill + length].append([pattern + (length,), k])
            left -= k
    return [(p, c) for at in open_ for p, c in at]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, first offset, repeats): pieces of a
    length with ranks [lo, hi) fill this run of equal slots. At most
    2 x seq_len patterns of at most sqrt(2 x seq_len) distinct lengths each:
    under 2 x seq_len x 64 rows at 2048."""
    out, used, base = [], {}, 0
    for pattern, count in patterns:
        offset, k = 0, 0
        while k < len(pattern):
            n = pattern[k]
            m = 1
            while k + m < len(pattern) and pattern[k + m] == n:
                m += 1
            lo = used.get(n, 0)
            used[n] = lo + count * m
            out.append((n, lo, lo + count * m, base, offset, m))
            offset += n * m
            k += m
        base += count
    return out


def pack(cut: DataFrame, seq_len: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset. Every piece gets exactly one
    place; offsets in a sequence are gapless from 0. Equal input rows are told
    apart by their rank. No rows in, no rows out."""
    spark = cut.sparkSession
    cut = stage(cut)
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = slots(pack_histogram(hist, seq_len))
    salts = max(1, -(-sum(hist.values()) // _RANK_GROUP)) * 4
    cut = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "start"), F.lit(salts)))
    before = stage(
        cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt"))
                                   - F.col("n")).alias("before")))
    local = cut.withColumn("r", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy(id_col, "start", "ids_crc32")) - 1)
    ranked = (local.alias("p").join(before.alias("b"), ["length", "salt"])
              .withColumn("r", F.col("r") + F.col("before")).drop("salt", "before"))
    place = F.broadcast(spark.createDataFrame(  # bounded: see slots()
        rows, "s_length long, lo long, hi long, first long, offset0 long, repeats long"))
    got = ranked.join(place, (F.col("length") == F.col("s_length")) & (F.col("r") >= F.col("lo"))
                      & (F.col("r") < F.col("hi")))
    step = F.col("r") - F.col("lo")
    return (got.withColumn("sequence_id", F.col("first") + F.floor(step / F.col("repeats")))
            .withColumn("offset", F.col("offset0") + F.pmod(step, F.col("repeats")) * F.col("length"))
            .drop("r", "s_length", "lo", "hi", "first", "offset0", "repeats"))


def sequences(packed: DataFrame, pad_id: int = 0, seq_len: int = 2048) -> DataFrame:
    """(sequence_id, ids array<int> of ``seq_len``) from packed pieces that
    carry ``ids``. A group is one sequence, at most ``seq_len`` ids. A
    sequence whose fill is a power of two stays unpadded."""
    got = packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
        .alias("ids"))
    n = F.size("ids").cast("long")
    full = n.bitwiseAND(n - 1) == 0
    return got.withColumn("ids", F.when(full, F.col("ids")).otherwise(
        F.concat("ids", F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(seq_len) - F.size("ids"))))))
