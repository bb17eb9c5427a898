"""Phrase collocation mining by SETM: relations of occurrences, kept sorted.

``R1`` holds the occurrences of all words by (piece, position). Each level
merge-joins the relation of the shorter phrases with itself on piece and
adjacent position, counts the phrases that come out (a group-count in Spark),
and semi-joins the occurrences with the frequent groups before they are
extended: an occurrence of a phrase needs one of its first words and one of
its last words next to it. Relations are staged tables; their sort order is
that of the text, so a join is one pass over neighbours.

A row of a relation holds the occurrences of a slice of one language's texts:
``ids`` its distinct words as 64-bit hashes of (lang, word), ``seq`` the words
as places in ``ids`` with -1 between pieces, ``at`` where phrases start (null:
everywhere). The semi-join goes through a bit filter of the frequent groups,
of at most 2^29 bits (64 MB) whatever their number: what it lets through by
chance is counted again and falls out there, so that counts are exact. Two
words of one hash would be found by a second hash and raise an error.

Defined results: null and empty texts hold nothing; a null lang is ``und`` and
one with rows of that name; repeated rows count as often as they occur; texts
of any length are cut between pieces only. Of the input only the text and lang
columns are read, so others may have any names. No rows give no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, buffers, column, drop_staged, mix, slices, span_hashes, stage

_GAP = np.zeros(256, bool)       # bytes that are in no word
_GAP[[0x20, 0x09]] = True
_EDGE = np.zeros(256, bool)      # bytes that end a piece
_EDGE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLES = [np.random.Generator(np.random.PCG64(s)).integers(1, 1 << 63, 256, dtype=np.uint64) for s in (41, 42)]
_P = U64(0x9E3779B97F4A7C15)
SLICE = 1 << 20                  # bytes of text in a row of a relation, about
_PARTS = 64                      # parts of a lang ranked on their own first
_BITS = (1 << 20, 1 << 29)       # least and most bits of a filter


# ------------------------------------------------------------- relations

def _stretches(data: np.ndarray):
    """(start, end) of stretches of about SLICE bytes that end with a piece."""
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            back = np.flatnonzero(_EDGE[data[at:end]][::-1][: SLICE // 2])
            if len(back):
                end -= int(back[0])
            else:                # one piece of any length
                while end < len(data) and not _EDGE[data[end - 1]]:
                    ahead = np.flatnonzero(_EDGE[data[end:end + SLICE]])
                    end = end + int(ahead[0]) + 1 if len(ahead) else min(end + SLICE, len(data))
        yield at, end
        at = end


def _words(lang: str, texts):
    """R1 rows of some texts of one language."""
    raw, off = buffers(texts)
    # a line feed after every text ends its last piece
    data = np.insert(raw, off[1:], 10) if len(off) > 2 else raw
    seed = span_hashes(np.frombuffer(lang.encode(), np.uint8), np.zeros(1, int), np.array([len(lang.encode())]), _TABLES[0])
    for lo, hi in _stretches(data):
        part = _LOWER[data[lo:hi]]
        edge = _EDGE[part]
        w = ~(edge | _GAP[part])
        step = np.diff(np.concatenate([[0], w.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(starts):
            continue
        ids = mix(span_hashes(part, starts, ends, _TABLES[0]) + seed * _P)
        check = (span_hashes(part, starts, ends, _TABLES[1]) >> U64(33)).astype(np.int32)
        uniq, first, code, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        if (check != check[first][code]).any():
            raise ValueError("two words share a hash; change the tables")
        pieces = np.concatenate([[0], np.cumsum(edge)])
        new = np.flatnonzero(pieces[starts[1:]] != pieces[ends[:-1]]) + 1
        s, e = starts[first], ends[first]
        to = np.concatenate([[0], np.cumsum(e - s)])
        chars = part[np.arange(to[-1]) + np.repeat(s - to[:-1], e - s)]
        text = pa.StringArray.from_buffers(len(s), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(chars.tobytes()))
        yield _row(lang=(pa.string(), lang), ids=uniq.view(np.int64), checks=check[first], words=text,
                   counts=count.astype(np.int64), seq=np.insert(code.astype(np.int32), new, -1))


def _row(**cols) -> pa.RecordBatch:
    out = {}
    for name, v in cols.items():
        if isinstance(v, tuple):
            out[name] = pa.array([v[1]], v[0])
        else:
            v = v if isinstance(v, pa.Array) else pa.array(v)
            out[name] = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    return pa.record_batch(out)


def occurrences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """R1 as a staged table."""
    def run(batches):
        for part in slices(batches, "text", 4 * SLICE):
            langs = column(part, "lang")
            for lang in langs.unique().to_pylist():
                yield from _words(lang, column(part.filter(pc.equal(langs, lang)), "text"))

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return stage(rows.where("length(text) > 0").mapInArrow(
        run, "lang string, ids array<long>, checks array<int>, words array<string>, counts array<long>, seq array<int>"))


def _list(batch, name: str, i: int) -> np.ndarray:
    return column(batch, name)[i].values.to_numpy(zero_copy_only=False)


def _spread(cols) -> np.ndarray:
    """One hash of the words of each phrase (a column for each word)."""
    h = np.full(len(cols[0]), len(cols), U64)
    for c in cols:
        h = h * _P + np.ascontiguousarray(c).view(U64)
    return mix(h)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & U64(len(bits) * 64 - 1)
    return (bits[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1


def filter_of(groups: DataFrame, cols: list[str]):
    """Bit filter of the rows of ``groups`` as a broadcast value: 16 bits a
    row, within _BITS, however many rows there are."""
    size = min(max(1 << (16 * groups.count() + 1).bit_length(), _BITS[0]), _BITS[1])

    def run(batches):
        for b in batches:
            h = _spread([column(b, c).to_numpy(zero_copy_only=False) for c in cols]) & U64(size - 1)
            yield pa.record_batch({"at": pa.array((h >> U64(6)).astype(np.int64)),
                                   "bit": pa.array((U64(1) << (h & U64(63))).view(np.int64))})

    got = groups.select(*cols).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.expr("bit_or(bit)").alias("bit"))
    got = got.toArrow()          # at most size / 64 rows
    bits = np.zeros(size // 64, U64)
    bits[got["at"].to_numpy()] = got["bit"].to_numpy().view(U64)
    return groups.sparkSession.sparkContext.broadcast(bits)


def _joined(batch, i: int, n: int, bits: np.ndarray | None):
    """Merge-join of a row's relation of (n-1)-word phrases with itself:
    (ids, seq, starts) of the n-word phrases; for n = 2 the frequent words,
    as ``bits`` has them, are joined."""
    ids, seq = _list(batch, "ids", i), _list(batch, "seq", i)
    if n == 2:
        ok = np.append(_held(bits, _spread([ids])), False)[seq]     # place -1 is the appended one
        return ids, seq, np.flatnonzero(ok[:-1] & ok[1:])
    at = _list(batch, "at", i)
    return ids, seq, at[:-1][np.diff(at) == 1]


def _phrases(ids, seq, at, n) -> list[np.ndarray]:
    return [ids[seq[at + k]] for k in range(n)]


def _count(relation: DataFrame, n: int, bits, least: int) -> DataFrame:
    """Frequent n-word phrases (id1..idn, f) as a staged table: each slice
    sums its own, Spark the slices'."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, seq, at = _joined(b, i, n, bits and bits.value)
                if not len(at):
                    continue
                key = seq[at].astype(np.int64)
                for k in range(1, n):           # exact: places in ids are below 2^31
                    rank = np.unique(key, return_inverse=True)[1] if k > 1 else key
                    key = rank.astype(np.int64) * len(ids) + seq[at + k]
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                yield pa.record_batch({**{f"id{k + 1}": pa.array(v) for k, v in enumerate(_phrases(ids, seq, at[first], n))},
                                       "f": pa.array(count.astype(np.int64))})

    cols = [f"id{k + 1}" for k in range(n)]
    need = ["ids", "seq"] + (["at"] if n > 2 else [])
    got = relation.select(*need).mapInArrow(run, ", ".join(f"{c} long" for c in cols) + ", f long")
    return stage(got.groupBy(*cols).agg(F.sum("f").alias("f")).where(F.col("f") >= least))


def _kept(relation: DataFrame, n: int, words, frequent) -> DataFrame:
    """The relation of the frequent n-word phrases, staged: words in none of
    them become ends of pieces."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, seq, at = _joined(b, i, n, words and words.value)
                at = at[_held(frequent.value, _spread(_phrases(ids, seq, at, n)))] if len(at) else at
                if not len(at):
                    continue
                used = np.zeros(len(seq), bool)
                for k in range(n):
                    used[at + k] = True
                seq = np.where(used, seq, -1)
                stay = used | np.append(True, used[:-1])    # one end after each run
                to = np.cumsum(stay) - 1
                seq, at = seq[stay], to[at]
                codes, place = np.unique(seq, return_inverse=True)
                if codes[0] == -1:
                    codes, place = codes[1:], place - 1
                yield _row(ids=ids[codes], seq=place.astype(np.int32), at=at.astype(np.int32))

    need = ["ids", "seq"] + (["at"] if n > 2 else [])
    return stage(relation.select(*need).mapInArrow(run, "ids array<long>, seq array<int>, at array<int>"))


# --------------------------------------------------------------- phrases

def _cut(phrase: DataFrame, n: int, counts: dict[int, DataFrame]) -> DataFrame:
    """The lowest-scoring cut of each n-word candidate: l, r, score."""
    cuts = []
    for k in range(1, n):
        for side, size, first in (("l", k, 1), ("r", n - k, k + 1)):
            own = counts[size].select(*[F.col(f"id{j + 1}").alias(f"id{first + j}") for j in range(size)],
                                      F.col("f").alias(f"{side}{k}"))
            phrase = phrase.join(own, [f"id{first + j}" for j in range(size)])
        cuts.append(F.struct(
            F.expr(f"cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) "
                   f"div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    phrase = phrase.withColumn("cut", F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0])
    return phrase.select(*[f"id{k + 1}" for k in range(n)], "a", "cut.l", "cut.r", "cut.score")


def _covered(candidates: dict[int, DataFrame], n: int, longest: int, share: int) -> DataFrame:
    """The n-word candidates without those whose words lie in a longer
    candidate of at least ``share`` percent of their count."""
    inside = None
    for m in range(n + 1, longest + 1):
        for at in range(m - n + 1):
            part = candidates[m].select(*[F.col(f"id{at + k + 1}").alias(f"id{k + 1}") for k in range(n)], "a")
            inside = part if inside is None else inside.unionByName(part)
    own = candidates[n]
    if inside is None:
        return own
    cols = [f"id{k + 1}" for k in range(n)]
    most = inside.groupBy(*cols).agg(F.max("a").alias("most"))
    return own.join(most, cols, "left").where(f"most is null or 100 * most < {share} * a").drop("most")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more, by
    their weakest cut: lang, rank, phrase, a, l, r, n, score; each lang's
    first ``top`` by score, count and phrase. A staged table."""
    with _small_batches(docs.sparkSession):
        return _mined(docs, longest, least, top, share, text_col, lang_col)


@contextmanager
def _small_batches(spark):
    """Rows of a relation hold a megabyte and more: Arrow batches of 8 MB
    instead of 64 bound what a task holds on both sides. The session's setting
    is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "8m")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def _mined(docs: DataFrame, longest: int, least: int, top: int, share: int, text_col: str, lang_col: str) -> DataFrame:
    r1 = occurrences(docs, text_col, lang_col)
    entries = r1.select("lang", F.explode(F.arrays_zip("ids", "checks", "counts")).alias("w"))
    words = entries.groupBy(F.col("w.ids").alias("id1")).agg(
        F.sum("w.counts").alias("f"), F.min("lang").alias("lang"), F.min("w.checks").alias("c"), F.max("w.checks").alias("d"))
    words = stage(words.where(f"f >= {least} or c <> d"))
    if not words.where("c <> d").isEmpty():
        raise ValueError("two words share a hash; change the tables")
    total = r1.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    counts = {1: words.select("id1", "f")}
    bits = filter_of(counts[1], ["id1"])
    relation, old = r1, []
    for n in range(2, longest + 1):
        counts[n] = _count(relation, n, bits, least)
        if n < longest:
            frequent = filter_of(counts[n], [f"id{k + 1}" for k in range(n)])
            relation = _kept(relation, n, bits, frequent)
            old.append(relation)
            frequent.unpersist()
    candidates = {n: counts[n].withColumnRenamed("f", "a") for n in range(2, longest + 1)}
    rows = None
    for n in candidates:
        got = _cut(_covered(candidates, n, longest, share), n, counts)
        got = got.select(F.array(*[f"id{k + 1}" for k in range(n)]).alias("ids"), "a", "l", "r", "score")
        rows = got if rows is None else rows.unionByName(got)
    rows = rows.join(words.select("id1", "lang"), F.col("ids")[0] == F.col("id1")).drop("id1")
    # the first of each lang: first within parts of it, then among those
    best = [F.desc("score"), F.desc("a")]
    for by in (["lang", F.pmod(F.xxhash64("ids"), F.lit(_PARTS))], ["lang"]):
        rows = rows.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*best)))
        rows = rows.where(F.col("place") <= top).drop("place")
    rows = stage(rows)
    named = _named(r1, rows)
    order = Window.partitionBy("lang").orderBy(*best, "phrase")
    got = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    got = stage(got.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    drop_staged(r1, words, rows, *old, *[counts[n] for n in candidates])
    return got


def _named(r1: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with their words' texts as ``phrase``."""
    used = rows.select(F.posexplode("ids").alias("pos", "id1"), "ids")
    wanted = stage(used.select("id1").distinct())
    bits = filter_of(wanted, ["id1"])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = _list(b, "ids", i)
                hit = np.flatnonzero(_held(bits.value, _spread([ids])))
                if len(hit):
                    yield pa.record_batch({"id1": pa.array(ids[hit]),
                                           "word": column(b, "words")[i].values.take(pa.array(hit))})

    texts = r1.select("ids", "words").mapInArrow(run, "id1 long, word string")
    texts = texts.groupBy("id1").agg(F.min("word").alias("word")).join(wanted, "id1", "left_semi")
    got = used.join(texts, "id1").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    got = got.select("ids", F.concat_ws(" ", F.col("w.word")).alias("phrase"))
    return stage(rows.join(got, "ids").drop("ids"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT k, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS pieces FROM d),
q AS (SELECT k, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS t FROM p),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM q),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (
  SELECT lang, 1 AS m, [ws[i]] AS ph, count(*) AS f FROM o GROUP BY ALL UNION ALL
  SELECT lang, 2, ws[i:i + 1], count(*) FROM o WHERE i + 1 <= len(ws) GROUP BY ALL UNION ALL
  SELECT lang, 3, ws[i:i + 2], count(*) FROM o WHERE i + 2 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, ph, f AS a FROM f WHERE m > 1 AND f >= 10),
gone AS (
  SELECT DISTINCT s.lang, s.ph FROM c s JOIN (
    SELECT lang, ph[1:2] AS part, a FROM c WHERE m = 3 UNION ALL SELECT lang, ph[2:3], a FROM c WHERE m = 3) t
  ON s.lang = t.lang AND s.ph = t.part AND 100 * t.a >= 50 * s.a),
cuts AS (
  SELECT c.lang, c.m, c.ph, c.a, k, ph[1:k] AS lp, ph[k + 1:m] AS rp
  FROM c JOIN (SELECT unnest([1, 2]) AS k) ON k < m ANTI JOIN gone ON c.lang = gone.lang AND c.ph = gone.ph),
s AS (
  SELECT cuts.lang, cuts.ph, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ph = lp JOIN f y ON y.lang = cuts.lang AND y.ph = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank,
       array_to_string(ph, ' ') AS phrase, a, l, r, n, score
FROM b JOIN n ON b.lang = n.lang QUALIFY rank <= 2000
"""
