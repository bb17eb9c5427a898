"""Near-duplicate documents by a chosen-path set similarity join.

Every document is a set of hashed word shingles; equal sets are one class.
A class carries minwise tokens (the least hash of its set under many hash
functions). In each of several independent trees the classes branch by a
chosen token: a node's members share the tokens chosen on the way. First all
members of each node are compared with its centre (the member that shares most
nodes); the links found merge members into components, and only pairs of
different components matter from then on. Nodes with few members are then
compared exhaustively. A larger node whose members outside its main component are few has
them compared with all its members; any other branches again, by two tokens at
once where one could not make it small. A comparison first looks at sizes and
512-bit signatures inside the join, so that few unlinked pairs leave it; the
rest are decided on the full sets, once each. The signature of a set of at most
512 shingles is the parity of its shingles in 512 bins: two sets differ by at
least the bits that differ, so that texts which share a passage and little else
stay apart. That of a larger set is two bits each of 256 minwise tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, buffers, column, components, drop_staged, holding, mix, shingles, slices, stage, word_hashes

TOKENS = 64      # minwise tokens of a class
TREES = 20       # a pair at 0.8 shares both root tokens in some tree with 1 - 0.36 ** 20
SMALL = 192      # members compared exhaustively
FEW = 192        # members outside the main component compared with the whole node
TWICE = 768      # larger nodes branch by two tokens at once
DEPTH = 16       # nodes that are still large here are compared exhaustively
_SIG = 256       # minwise tokens of which a signature keeps two bits each, in 8 longs
_BINS = 512      # of a parity signature, and the most shingles of a set judged by it
_SIGMAS = 4.2    # a pair at the bound has a signature further apart than allowed once in 7e4


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(1, 1 << 31, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 31, n, dtype=np.uint32)


def _sets(batch: pa.RecordBatch, text_col: str, words: int) -> list[np.ndarray]:
    h, at = word_hashes(*buffers(column(batch, text_col)))
    return [shingles(h[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, key, key2, sig, tokens) per row; ``key``/``key2``
    identify the set; ``sig`` begins with the parity signature (8 longs) of
    sets that a set of at most 512 may be linked with and ends, for sets of
    more, with the low bits of 256 tokens (4 longs) and their second bits;
    ``tokens`` are the first 64."""
    schema = T.StructType([docs.schema[id_col]] + [T.StructField(c, T.LongType()) for c in ("n_shingles", "key", "key2")]
                          + [T.StructField("sig", T.ArrayType(T.LongType())),
                             T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        mul, add = (c[:, None] for c in _coefficients(_SIG))
        for batch in slices(batches, text_col):
            rows = []
            for s in _sets(batch, text_col, words):
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                m = _SIG if len(s) > _BINS else TOKENS
                low, high = np.full(m, np.iinfo(np.uint32).max, np.uint32), (s >> U64(32)).astype(np.uint32)
                for a in range(0, len(s), 1024):
                    h = high[None, a:a + 1024] * mul[:m]
                    h += add[:m]
                    low = np.minimum(low, h.min(1))
                top = (mix(low.astype(U64)) >> U64(32)).astype(np.uint32)
                bits = []
                if len(s) * num <= _BINS * den:
                    bits.append(np.bincount((s & U64(_BINS - 1)).astype(np.intp), minlength=_BINS) & 1)
                if len(s) > _BINS:
                    bits += [top & 1, top >> 1 & 1]
                sig = np.packbits(np.concatenate(bits).astype(np.uint8)).view(np.int64)
                rows.append((len(s), int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s)).view(np.int64)),
                             sig, top[:TOKENS].view(np.int32)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col), *[pa.array(c, pa.int64()) for c in cols[:3]],
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int32()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sets_of(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles array<long>) of whole texts."""
    def run(batches):
        for batch in slices(batches, text_col):
            got = [s.view(np.int64) for s in _sets(batch, text_col, words)]
            yield pa.RecordBatch.from_arrays([column(batch, "rep"), pa.array(got, pa.list_(pa.int64()))],
                                             names=["rep", "shingles"])
    return docs.select(F.col(id_col).cast("long").alias("rep"), text_col).mapInArrow(
        run, "rep long, shingles array<long>")


def _maybe(a: str, b: str, num: int, den: int):
    """What a linked pair must satisfy: set sizes within the bound, no more
    parities apart than shingles may be; of larger sets, signatures mostly
    equal (of two bits, a token that differs shows in three of four)."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    off = 0.75 * (1 - num / den)
    most = int(_SIG * off + _SIGMAS * (_SIG * off * (1 - off)) ** 0.5)
    odd = F.expr(" + ".join(f"bit_count({a}.sig[{i}] ^ {b}.sig[{i}])" for i in range(_BINS // 64)))

    def differ(i):
        return f"(element_at({a}.sig, {i}) ^ element_at({b}.sig, {i}))"

    apart = F.expr(" + ".join(f"bit_count({differ(i - 8)} | {differ(i - 4)})" for i in range(4)))
    near = F.when(F.least(na, nb) <= _BINS, odd * (den + num) <= (na + nb) * (den - num)).otherwise(apart <= most)
    return (na * den >= nb * num) & (nb * den >= na * num) & near


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of staged pairs, decided on the full sets."""
    sets = holding(sets, "rep", pairs.select("a").union(pairs.select("b")))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("shingles").alias(f"_{side}")).hint("merge"), side)
    inter = F.size(F.array_intersect("_a", "_b")).cast("long")
    got = pairs.select("a", "b", inter.alias("i"), (F.size("_a") + F.size("_b")).alias("t"))
    return got.select("a", "b", (F.col("i") * den >= (F.col("t") - F.col("i")) * num).alias("linked"))


def _pairs(left: DataFrame, right: DataFrame, on, num: int, den: int) -> DataFrame:
    got = left.alias("l").join(right.alias("r"), (F.col("l.node") == F.col("r.node")) & on & _maybe("l", "r", num, den))
    return got.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))


def _centres(members: DataFrame) -> DataFrame:
    """The member of each node that shares most nodes, the least on a tie."""
    top = F.max(F.struct("central", (-F.col("rep")).alias("r"), "n", "sig", "cls")).alias("c")
    return members.groupBy("node").agg(top).select("node", (-F.col("c.r")).alias("rep"), "c.n", "c.sig", "c.cls")


def links(reps: DataFrame, docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(node, comp) of the classes that have a link; reps: rep, n, sig, tokens."""
    t = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    root = reps.select("rep", "tokens", t).select(
        F.xxhash64("t", F.expr("tokens[2 * t]"), F.expr("tokens[2 * t + 1]")).alias("node"), "rep")
    sizes = root.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    members = stage(root.join(sizes.hint("merge"), "node"))
    central = stage(members.groupBy("rep").agg(F.sum("m").alias("central")))
    signed = reps.select("rep", "n", "sig").join(central.hint("merge"), "rep")
    members = stage(members.join(signed.hint("merge"), "rep").select(
        "node", "rep", "n", "sig", "central", F.col("rep").alias("cls")))
    src = holding(docs, id_col, central).join(
        central.select(F.col("rep").alias(id_col)).hint("merge"), id_col, "left_semi")
    sets = stage(sets_of(src, words, id_col, text_col))
    tokens = None

    def relabelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """Members of nodes with several classes: their class, the node's
        main class and whether the node is compared as a whole or is very large."""
        rows = rows.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select(
            "node", "rep", "n", "sig", "central", F.coalesce("comp", "rep").alias("cls"))
        per = rows.groupBy("node", "cls").agg(F.count("*").alias("k"))
        info = per.groupBy("node").agg(
            F.sum("k").alias("m"), F.count("*").alias("classes"),
            F.max(F.struct("k", (-F.col("cls")).alias("c"))).alias("top")).where("classes > 1")
        ready = (F.col("m") <= SMALL) | (F.col("m") - F.col("top.k") <= FEW) | F.lit(depth >= DEPTH)
        return stage(rows.join(info.select("node", (-F.col("top.c")).alias("main"), ready.alias("ready"),
                                           (F.col("m") > TWICE).alias("twice")), "node"))

    def grown(rows: DataFrame, on) -> DataFrame:
        """The next chosen tokens of nodes where ``on``: one branch, and a second for a quarter of them."""
        token = F.element_at("tokens", (F.pmod(F.xxhash64("node", "branch"), F.lit(TOKENS)) + 1).cast("int"))
        extra = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(4)) == 0
        branches = F.when(~on, F.array(F.lit(-1))).when(extra, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return rows.withColumn("branch", F.explode(branches)).withColumn(
            "node", F.when(F.col("branch") < 0, F.col("node")).otherwise(F.xxhash64("node", "branch", token))).drop("branch")

    # first every member against its node's centre
    other = F.col("l.rep") != F.col("r.rep")
    tried = stage(_verified(stage(_pairs(members, _centres(members), other, num, den).distinct()), sets, num, den))
    comp = components(tried.where("linked").select("a", "b"))
    depth = 0
    members = relabelled(members.drop("cls"), comp)
    while True:
        apart = F.col("l.cls") != F.col("r.cls")
        # members outside the main component against all members of another one
        whole, wide = members.where("ready"), members.where("not ready")
        once = (F.col("r.cls") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep"))
        pairs = _pairs(whole.where("cls <> main"), whole, apart & once, num, den)
        # in large nodes all members against a centre from outside the main component
        pairs = pairs.union(_pairs(wide, _centres(wide.where("cls <> main")), apart, num, den))
        pairs = stage(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            got = stage(_verified(pairs, sets, num, den))
            tried = tried.union(got)
            new = got.where("linked")
            if not new.isEmpty():  # link the components found so far
                here = comp.select("node", "comp")
                joined = (new.join(here.toDF("a", "ca"), "a", "left").join(here.toDF("b", "cb"), "b", "left")
                          .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
                comp = components(joined.union(comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        if wide.isEmpty():
            drop_staged(sets)
            return comp
        if tokens is None:
            tokens = stage(reps.join(central.hint("merge"), "rep", "left_semi").select("rep", "tokens"))
        depth += 1
        wide = grown(wide.drop("cls", "main", "ready").join(tokens, "rep"), F.lit(True))
        members = relabelled(grown(wide, F.col("twice")).drop("tokens", "twice"), comp)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Two documents are linked when ``den`` x intersection >= ``num`` x union of
    their sets of ``words``-word shingles (words between white space, A-Z
    lower-cased; a shorter text is one shingle). ``component_id`` is the least
    id reachable over links, ``kept`` marks the row that carries it. Texts
    that are null, empty or without a word have an empty set and link with
    nothing. Rows that repeat an id are one document whose links are those of
    all its texts. Rows with a null id are neither linked nor kept and have a
    null component. The id must be an integer; other columns are not read."""
    rows = stage(sketches(docs, words, id_col, text_col))
    some = rows.where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    reps = stage(some.groupBy("n_shingles", "key", "key2").agg(
        F.min(F.struct(F.col(id_col).cast("long").alias("rep"), "sig", "tokens")).alias("m"))
        .select(F.col("n_shingles").alias("n"), "key", "key2", "m.*"))
    comp = links(reps.select("rep", "n", "sig", "tokens"), docs, words, num, den, id_col, text_col)
    # rows of a class to its class's component; an id with several texts joins their components
    of_class = reps.select(F.col("n").alias("n_shingles"), "key", "key2", "rep")
    mine = some.select(F.col(id_col).cast("long").alias("id"), "n_shingles", "key", "key2")
    joined = mine.join(of_class, ["n_shingles", "key", "key2"]).select("id", "rep").where("id <> rep").distinct()
    twice = joined.groupBy("id").agg(F.count("*").alias("c"))
    also = joined.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    if twice.where("c > 1").isEmpty() and also.isEmpty():
        per = joined.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
            "id", F.coalesce("comp", "rep").alias("comp")).union(comp)
    else:
        per = components(joined.select(F.col("id").alias("a"), F.col("rep").alias("b")).union(comp)).select(
            F.col("node").alias("id"), "comp")
    got = rows.select(id_col, "n_shingles").join(per.toDF(id_col, "_comp").distinct(), id_col, "left")
    comp_id = F.coalesce("_comp", F.col(id_col).cast("long"))
    return got.select(id_col, "n_shingles", comp_id.alias("component_id"),
                      F.coalesce(F.col(id_col) == comp_id, F.lit(False)).alias("kept"))
