"""Line deduplication by a deletion-neighbourhood join.

A line is dropped when an earlier line (least document id, then line number)
equals it or is one edit away (a character inserted, deleted or replaced).
Lines compare with A-Z lower-cased and white space trimmed and squeezed;
blank lines stay as they are. Lines below ``min_chars`` characters match only
as equals.

Two different lines one replacement apart have equal deletion variants at
the same position, and a deletion variant of the longer of two lines one
insertion apart is the shorter. So each distinct line emits the hashes of all
its one-deletion variants with their positions: the group of a (variant,
position) holds no more rows than there are characters, and its least row is
the earliest line of all. Before that, lines that share neither half with any
other line are put aside (one edit leaves one half equal, so none is missed).
Edit distances are confirmed on the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, _powers, buffers, column, free_name, holding, mix, slices, stage

_CHARS = mix(np.arange(1 << 16, dtype=np.uint64) + U64(99))
_CHARS[65:91] = _CHARS[97:123]


class Lines:
    """Normalised lines of the texts of one slice: code points ``cp``, spans
    [start, end), text and line number of each line with a character."""

    def __init__(self, col):
        data, off = buffers(col)
        lead = (data & 0xC0) != 0x80
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(lead)])[off]  # text offsets in characters
        nl = cp == 10
        space = (cp == 32) | ((cp >= 9) & (cp <= 13))
        edge = np.zeros(len(cp) + 1, bool)  # a line starts here
        edge[at] = True
        edge[1:][nl] = True
        edge = edge[:-1]
        prev = np.concatenate([[True], space[:-1]]) | edge
        keep = ~(space & prev) & ~nl
        # a kept space that ends its line goes too
        last = np.zeros(len(cp), bool)
        nxt = np.concatenate([edge[1:], [True]]) | np.concatenate([nl[1:], [True]])
        run = np.flatnonzero(space & ~nl)
        if len(run):  # spaces up to the end of a line
            end = np.concatenate([space[1:], [True]]) | nxt
            stop = np.flatnonzero(~(space | nl))
            after = np.searchsorted(stop, run)
            following = np.where(after < len(stop), stop[np.minimum(after, max(len(stop) - 1, 0))] if len(stop) else 0,
                                 len(cp))
            line_id = np.cumsum(edge)
            same = np.zeros(len(run), bool)
            ok = following < len(cp)
            same[ok] = line_id[following[ok]] == line_id[run[ok]]
            last[run] = ~same & end[run]
            last[run] |= ~same
        keep &= ~last
        line = np.cumsum(edge) - 1
        first_line = line[np.minimum(at[:-1], max(len(cp) - 1, 0))] if len(cp) else np.zeros(len(at) - 1, np.int64)
        kept = np.flatnonzero(keep)
        self.cp = np.where(space[kept], np.uint32(32), cp[kept])
        owner = line[kept]
        new = np.ones(len(kept), bool)
        new[1:] = owner[1:] != owner[:-1]
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(kept))
        number = owner[self.start]
        where = kept[self.start]
        self.text = np.searchsorted(at, where, "right") - 1
        # empty texts share an offset with the next one: take the one that has characters
        self.number = number - first_line[self.text]
        low = np.minimum(self.cp, (1 << 16) - 1)
        val = _CHARS[low]
        high = self.cp >= 1 << 16
        if high.any():
            val[high] = mix(self.cp[high].astype(U64) + U64(99))
        self.pw, self.inv = _powers(len(self.cp) + 2)
        self.h = np.zeros(len(self.cp) + 1, U64)
        np.cumsum(val * self.pw[: len(self.cp)], out=self.h[1:])

    def hashes(self, start, end):
        """Hash of the characters of each span."""
        return mix((self.h[end] - self.h[start]) * self.inv[start] + (end - start).astype(U64))

    def halves(self) -> np.ndarray:
        """Four keys a line; lines one edit apart have one in common."""
        out = []
        for shorter in (0, 1):  # as the shorter line, and as the longer one
            size = (self.end - self.start) - shorter
            p = size // 2
            out.append(mix(self.hashes(self.start, self.start + p) + size.astype(U64) * U64(2)))
            out.append(mix(self.hashes(self.end - (size - p), self.end) + size.astype(U64) * U64(2) + U64(1)))
        return np.stack(out, 1)

    def variants(self, a: int, b: int):
        """(line, position, hash) of every one-deletion variant of lines a..b."""
        s, e = self.start[a:b], self.end[a:b]
        n = e - s
        line = np.repeat(np.arange(a, b), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s, e = np.repeat(s, n), np.repeat(e, n)
        i = s + pos
        left = self.h[i] - self.h[s]
        right = (self.h[e] - self.h[i + 1]) * self.inv[1]
        return line, pos, mix((left + right) * self.inv[s] + (e - s - 1).astype(U64))

    def string(self, k: int) -> str:
        raw = self.cp[self.start[k]:self.end[k]].astype("<u4").tobytes().decode("utf-32-le")
        return raw.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)}


def _i64(a):
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, h, size, keys) of every line that is not blank."""
    schema = "id long, line int, h long, size int, keys array<long>"

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            x = Lines(column(batch, "text"))
            keys = x.halves()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id").take(pa.array(x.text)), pa.array(x.number.astype(np.int32)),
                 _i64(x.hashes(x.start, x.end)), pa.array((x.end - x.start).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * 4), _i64(keys.reshape(-1)))],
                names=["id", "line", "h", "size", "keys"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.where("id is not null").mapInArrow(run, schema)


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, text) of the wanted (id, line, h) lines."""
    per = stage(wanted.groupBy("id").agg(F.collect_set("h").alias("hs")))  # of one document's lines

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            x = Lines(column(batch, "text"))
            h = x.hashes(x.start, x.end).view(np.int64)
            hs = column(batch, "hs").to_pylist()
            want = [set(v) for v in hs]
            pick = [k for k, (t, v) in enumerate(zip(x.text.tolist(), h.tolist(), strict=True)) if v in want[t]]
            yield pa.RecordBatch.from_arrays([pa.array(h[pick]), pa.array([x.string(k) for k in pick], pa.string())],
                                             names=["h", "text"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return holding(src, "id", per).join(per.hint("merge"), "id").select("text", "hs").mapInArrow(run, "h long, text string").dropDuplicates(["h"])


def _emit(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            x = Lines(column(batch, "text"))
            h = column(batch, "h").to_numpy()
            owner = h[x.text]
            a = 0
            size = np.cumsum(x.end - x.start)
            while a < len(size):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (1 << 18), "right")))
                line, pos, v = x.variants(a, b)
                yield pa.RecordBatch.from_arrays([_i64(v), pa.array(pos.astype(np.int32)), pa.array(owner[line])],
                                                 names=["v", "pos", "h"])
                a = b
    return texts.select("h", "text").mapInArrow(run, "v long, pos int, h long")


def near_lines(classes: DataFrame, docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h, by): distinct lines with an earlier line one edit away, and that
    line. classes: h, ord (id, line), size, keys."""
    long_ = classes.where(F.col("size") >= min_chars)
    keys = long_.select("h", F.explode("keys").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"))
    alive = keys.join(shared, "key").select("h").distinct()
    alive = stage(long_.join(alive, "h").select("h", "ord", "ord.id", "ord.line"))
    texts = stage(_texts(docs, alive, id_col, text_col))
    emitted = _emit(texts).join(alive.select("h", "ord"), "h")
    emitted = stage(emitted.select("v", "pos", "h", "ord"))
    group = Window.partitionBy("v", "pos")  # at most one line for each character
    first = F.min(F.struct("ord", "h")).over(group)
    replaced = emitted.withColumn("first", first).where(F.col("first.h") != F.col("h")).select(
        "h", F.col("first.h").alias("by"), F.col("first.ord").alias("by_ord"))
    shorter = alive.select(F.col("h").alias("v"), F.col("ord").alias("s_ord"))
    pairs = emitted.join(shorter, "v").where("v <> h")
    grown = pairs.select(F.when(F.col("s_ord") < F.col("ord"), F.col("h")).otherwise(F.col("v")).alias("h"),
                         F.when(F.col("s_ord") < F.col("ord"), F.col("v")).otherwise(F.col("h")).alias("by"),
                         F.least("s_ord", "ord").alias("by_ord"))
    found = stage(replaced.union(grown).distinct())
    checked = (found.join(texts, "h").join(texts.toDF("by", "by_text"), "by")
               .where(F.levenshtein("text", "by_text", 1) == 1))
    return checked.groupBy("h").agg(F.min(F.struct("by_ord", "by"))["by"].alias("by"))


def dropped_lines(docs: DataFrame, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, h, near) of every line to drop; ``near``: for an earlier
    line one edit away and not for an equal one."""
    every = stage(lines(docs, id_col, text_col))
    classes = stage(every.groupBy("h").agg(F.min(F.struct("id", "line")).alias("ord"), F.count("*").alias("n"),
                                           F.first("size").alias("size"), F.first("keys").alias("keys")))
    near = stage(near_lines(classes, docs, min_chars, id_col, text_col))
    drop = stage(classes.join(near, "h", "left").where("n > 1 or by is not null").select(
        "h", "ord", F.col("by").isNotNull().alias("near")))
    got = every.select("id", "line", "h").join(drop, "h")
    own = (F.col("id") == F.col("ord.id")) & (F.col("line") == F.col("ord.line"))
    return got.where(F.col("near") | ~own).select("id", "line", "h", (F.col("near") & own).alias("near"))


def dedup(docs: DataFrame, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text",
          out: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the dropped lines taken out of
    the text, and n_lines, n_dropped (lines that are not blank), named
    ``out``, by default with leading underscores on a clash. Null texts stay null and
    rows without an id stay as they are; they give no lines to compare with.
    Rows that repeat an id count as one document: a line is dropped from each
    of them alike. The order of ids decides which line is the earliest, not
    the order of rows."""
    per = stage(dropped_lines(docs, min_chars, id_col, text_col).groupBy("id").agg(
        F.collect_set(F.struct("line", "h")).alias("_gone")))  # of one document's lines
    counts = out or [free_name(c, docs.columns) for c in ("n_lines", "n_dropped")]
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.IntegerType()) for c in counts]])
    gone = holding(docs, id_col, per).withColumn("_id", F.col(id_col).cast("long")).join(
        per.withColumnRenamed("id", "_id").hint("merge"), "_id", "left").select(*names, "_gone")
    free = holding(docs, id_col, per, hit=False)  # no text of these moves

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            texts = column(batch, text_col).to_pylist()
            lost = [0] * batch.num_rows
            split = [t.split("\n") if t else [] for t in texts]
            total = [sum(1 for k in ls if k.strip(" \t\r\x0b\x0c")) for ls in split]
            if "_gone" in batch.schema.names:
                sets = column(batch, "_gone").to_pylist()
                some = [r for r, g in enumerate(sets) if g]
                x = Lines(column(batch, text_col).take(pa.array(some, pa.int32())))
                h = x.hashes(x.start, x.end).view(np.int64).tolist()
                cut, number = np.searchsorted(x.text, np.arange(len(some) + 1)), x.number.tolist()
                for k, r in enumerate(some):
                    pairs = {(e["line"], e["h"]) for e in sets[r]}
                    drop = {number[j] for j in range(cut[k], cut[k + 1]) if (number[j], h[j]) in pairs}
                    lost[r] = len(drop)
                    texts[r] = "\n".join([t for j, t in enumerate(split[r]) if j not in drop])
            cols = [pa.array(texts, pa.string()) if c == text_col else column(batch, c) for c in names]
            cols += [pa.array(total, pa.int32()), pa.array(lost, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *counts])

    return gone.mapInArrow(run, schema).union(free.mapInArrow(run, schema))
