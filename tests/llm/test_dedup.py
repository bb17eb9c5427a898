"""MinHash, line and embedding near-duplicates against brute force."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import embed_dedup, line_dedup, minhash_dedup
from tessera.llm.common import components, holding

LOW = {i: i + 32 for i in range(65, 91)}


def _closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _sets(rows, words):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return out


def _check_minhash(df, words):
    rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None]
    s = _sets(rows, words)
    links = [(a, b) for a, b in itertools.combinations(sorted(s), 2)
             if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = _closure(s, links)
    got = minhash_dedup.near_duplicates(df, words=words).collect()
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert r["n_shingles"] == len(s[r["doc_id"]])
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_minhash_edge_cases(docs):
    _check_minhash(docs, 4)
    _check_minhash(docs.limit(0), 4)


def test_minhash_large_near_group(spark):
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):  # more than SMALL members, many pairs just below and above the bound
        w = list(base)
        for k in r.sample(range(80), r.randint(0, 6)):
            w[k] = f"r{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    _check_minhash(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_minhash_shared_passage_leaves_few_pairs(spark, monkeypatch):
    """Texts that share a passage but stay below the bound (J = 0.76) do not
    reach the comparison of full sets."""
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(6)])) for i in range(260)]
    rows += [(1000, " ".join(passage + [f"own7x{k}" for k in range(5)] + ["new"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    verified = minhash_dedup._verified
    monkeypatch.setattr(minhash_dedup, "_verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, words=4).collect()}
    assert got.pop(1000) == 7 and all(i == c for i, c in got.items())
    assert sum(seen) <= len(rows)


def test_minhash_both_signatures_at_their_border(spark):
    """Sets on both sides of the size up to which parities decide."""
    r = random.Random(9)
    rows = []
    for n in (500, 515, 520, 560, 640, 645, 700):
        base = [f"w{n}x{i}" for i in range(n)]
        for k, cut in enumerate((n, n, int(n * 0.97), int(n * 0.9), int(n * 0.82), int(n * 0.79))):
            w = base[:cut]
            if k == 1:
                w[r.randrange(n)] = "other"
            rows.append((len(rows), " ".join(w)))
    _check_minhash(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def _lines_brute(rows, min_chars):
    norm = [(i, k, re.sub(r"[ \t\r\x0b\x0c]+", " ", x).strip(" ").translate(LOW))
            for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    norm = sorted({(i, k, n) for i, k, n in norm if n})
    def one(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < min_chars:
            return False
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        return a[p + 1:] == b[p + 1:] or a[p:] == b[p + 1:] or a[p + 1:] == b[p:]
    return {(i, k) for j, (i, k, n) in enumerate(norm) if any(m == n or one(m, n) for _, _, m in norm[:j])}


def test_line_dedup(docs, spark):
    r = random.Random(1)
    def line():
        s = list("the quick brown fox number seven")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randrange(len(s))
            s[k:k + r.choice([0, 1])] = r.choice(["", "x", "é", "🙂"])
        return "".join(s)
    more = spark.createDataFrame([(100 + i, "\n".join(line() for _ in range(4)), "s", 0.0, 0) for i in range(40)], docs.schema)
    df = docs.union(more)
    rows = {(x["doc_id"], x["text"]) for x in df.collect() if x["doc_id"] is not None}
    gone = _lines_brute(rows, 16)
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "_n_lines", "n_dropped"]
    out = got.collect()
    assert len(out) == df.count()
    for x in out:
        t = next((t for i, t in rows if i == x["doc_id"]), "text without an id at all")
        want = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (x["doc_id"], k) not in gone)
        assert x["text"] == want
    assert line_dedup.dedup(df.limit(0)).count() == 0


def _check_embeddings(rows, df, **kw):
    def ok(v, lab):
        return (lab is not None and v is not None and all(e is not None and math.isfinite(e) for e in v)
                and any(e != 0 for e in v))
    use = [(i, v, lab) for i, v, lab in rows if ok(v, lab)]
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    links = [(a[0], b[0]) for a, b in itertools.combinations(use, 2) if a[2] == b[2] and cos(a[1], b[1]) >= 0.93]
    comp = _closure([i for i, _, _ in rows], links)
    deg = {i: sum(i in e for e in links) for i, _, _ in rows}
    got = embed_dedup.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (deg[r["vec_id"]], comp[r["vec_id"]],
                                                               comp[r["vec_id"]] == r["vec_id"])


@pytest.mark.parametrize("leaf", [512, 40])
def test_embeddings(spark, leaf):
    r = random.Random(7)
    rows, n = [], 0
    for lab in (0, 1):
        for _ in range(60):
            c = [r.gauss(0, 1) for _ in range(16)]
            for _ in range(r.choice([1, 1, 2, 5])):
                rows.append((n, [float(x + r.gauss(0, 0.08)) for x in c], lab))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 1),
             (n + 4, [None] + [1.0] * 15, 1), (n + 5, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _check_embeddings(rows, df, leaf=leaf)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_and_filter(spark):
    r = random.Random(3)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(e, "a long, b long")).collect()}
    nodes = {n for p in e for n in p}
    want = _closure(nodes, e)
    assert all(got.get(n, n) == want[n] for n in nodes)
    ids = spark.range(0, 1000, 7)
    df = spark.range(1000).withColumnRenamed("id", "k")
    near = holding(df, "k", ids)
    assert near.join(ids, F.col("k") == F.col("id")).count() == 143
    assert near.count() + holding(df, "k", ids, hit=False).count() == 1000


def test_embeddings_of_unequal_lengths(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0], 1) for i in range(6)] + [(10 + i, [1.0, 0.0, 0.0, 0.01 * i], 1) for i in range(3)]
    rows += [(20, [1.0, 0.0, 0.0], 2), (21, [], 1), (22, None, 1), (23, [0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows],
                               "vec_id long, embedding array<float>, label int, component_id string, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {**{i: (5, 0) for i in range(6)}, **{10 + i: (2, 10) for i in range(3)},
                   20: (0, 20), 21: (0, 21), 22: (0, 22), 23: (0, 23)}


def test_search_of_unequal_lengths(spark):
    from tessera.llm import ann
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(20)] + [(50, [1.0, 2.0, 3.0, 4.0]), (51, [1.0]), (52, None), (53, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = ann.search(df, df.where("vec_id in (0, 7, 50)"), ann.fit(df), k=3).collect()
    want = {0: [1, 2, 3], 7: [6, 8, 5]}
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    assert {r["query_id"] for r in got} == {0, 7}
