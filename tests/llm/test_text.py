"""Encoding, packing, HTML, classifiers, language model and search."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_text, lm_score, packing, piece_bpe, quality, toxicity
from tessera.llm.common import word_hashes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["  ", " ", "\n", "a", "the", "é", "日本", "🙂", "\x00", "▁", "<s>", "ing", "—", "\t", "00", "ﬁ", "한국", "=", "--", "<|endoftext|>"]


def _texts(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_sentencepiece_equals_library(spark, docs):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    m = piece_bpe.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = _texts(2000) + ["a" * 3000, " " * 200, "==" * 300]
    for t, raw in zip(texts, m.encode(texts)):
        ids = np.frombuffer(raw, np.int32)
        assert ids.tolist() == lib.encode(t) and m.decode(ids) == lib.decode(lib.encode(t))
    r = random.Random(1)
    for _ in range(500):
        ids = [r.randrange(300) for _ in range(r.randint(0, 9))]
        assert m.decode(np.array(ids, np.int64)) == lib.decode(ids)
    got = piece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rows = got.collect()
    assert len(rows) == docs.count() and all(lib.decode(x["ids"]) == x["decoded"] for x in rows)
    assert piece_bpe.round_trip(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in _texts(500, 5):
        assert packing.encode(RANKS, t) == lib.encode(t, add_special_tokens=False).ids
    got = packing.pack(packing.pieces(docs, RANKS, with_ids=True))
    rows = got.collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        own = sorted({(r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in rows if r["doc_id"] == i})
        assert [x for _, p, _ in own for x in p] == ids and {n for _, _, n in own} == {len(ids)}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0
               for r in packing.sequences(got).collect())
    assert packing.pack(packing.pieces(docs.limit(0), RANKS)).count() == 0


def test_pack_histogram_keeps_every_length():
    r = random.Random(2)
    hist = {r.randint(1, 2048): r.randint(1, 50) for _ in range(300)}
    left = dict(hist)
    for pattern, count in packing.pack_histogram(hist, 2048):
        assert sum(pattern) <= 2048
        for n in pattern:
            left[n] -= count
    assert set(left.values()) == {0}


HTML = """<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="sidebar">side</div>
<article><h1>Title &amp; more</h1><p>First   paragraph of <b>prose, long enough to count.<br>Next line.</p>
<div class="comments"><p>A reader comment that is long enough to count as prose.</p></div>
<form><p>Sign up now</p></form><p>Second paragraph&nbsp;here.</article><footer>&copy; x</footer>
<script>var a="</p><p>no</p>"</script></body></html>"""


def test_html(spark):
    want = "Title & more\n\nFirst paragraph of prose, long enough to count. Next line.\n\nSecond paragraph here."
    plain = "<div class=\"box-7\"><p>Only a div here, yet it holds some text of a page.</p></div>"
    rows = [(1, "http://a.example/x", HTML, 1), (2, "http://a.example/y", None, 1), (3, None, plain, 1), (4, "x", "", 1),
            (5, "http://a.example/z", plain, 1), (5, "http://a.example/z", plain, 1), (6, "u", "<p>" * 5000 + "a<b", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1] == want and got[2] == "" and got[4] == "" and got[6].startswith("a")
    assert got[3] == got[5] == "Only a div here, yet it holds some text of a page."
    assert html_text.extract(df).count() == 7 and html_text.extract(df.limit(0)).count() == 0


def test_html_keeps_articles_of_marked_pages():
    prose = "<p>First paragraph of prose that is long enough to count as such.</p>"
    want = "First paragraph of prose that is long enough to count as such."
    for shell in ('<div class="site-content has-sidebar">%s</div>', '<div class="content no-sidebar">%s</div>',
                  '<html class="js cookie-consent"><body>%s</body></html>', '<div class="page header-fixed">%s</div>',
                  '<html class="modal"><body class="sidebar"><div class="widget"><main>%s</main></div></body></html>'):
        got = html_text.Page(shell % f'<article>{prose}</article><div class="sidebar">Other pages</div>').text(None)
        assert got == want, shell
    side = '<div class="sidebar"><p>A box that stands beside the text of the page.</p></div>'
    assert html_text.Page(f"<body><div>{prose}{prose}</div>{side}</body>").text("body") == f"{want}\n\n{want}"
    assert html_text.Page(f'<body><div class="widget">{prose}</div><p>x</p></body>').text("body") == f"{want}\n\nx"
    page = html_text.Page(f"""<article>{prose}<h2 id="related-work">Related work</h2><section id="discussion"><p>Spoken.</p>
        </section><h2 class="search" id="search">Search</h2><p id="search-methods">Methods.</p><div class="feedback-loop">Loops.</div>
        <figure><img src=a><figcaption>Caption.</figcaption></figure><div class="comments"><p>Gone.</p></div></article>""")
    assert page.text(None).split("\n\n") == [want, "Related work", "Spoken.", "Search", "Methods.", "Loops.", "Caption."]


def _labelled(spark, bad, good, n=200):
    r = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)) + (f" {bad} {bad}" if i % 4 == 0 else f" {good}"))
            for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, None), (n + 1, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)] + [(None, 1), (n, None)], "doc_id long, y int")
    return docs, lab


def test_quality_held_out(spark):
    docs, lab = _labelled(spark, "junk", "fine")
    model = quality.fit(docs, lab, F.col("doc_id") % 5 != 0, label="y")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(200) if i % 5 == 0]
    assert min(got[i] for i in held if i % 4 == 0) > max(got[i] for i in held if i % 4) and len(got) == 203
    none = quality.fit(docs, lab.limit(0), F.lit(True), label="y")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_held_out_and_exact_search(spark):
    docs, lab = _labelled(spark, "scumbag", "fine")
    index = toxicity.fit(docs, lab, F.col("doc_id") % 5 != 0, label="y", least_gain=12.0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, index).collect()}
    assert all((got[i]["score"] > 0.5) == (i % 4 == 0) for i in range(0, 200, 5))
    assert got[200]["evidence"] == [] and got[0]["evidence"][0]["label"] == 1
    r = np.random.default_rng(0)
    ix = toxicity.ToxicityIndex(np.arange(50, dtype=np.uint64), np.ones(50), np.arange(300), np.zeros(300), k=7)
    vec = [ix.vector(r.integers(0, 50, r.integers(1, 12))) for _ in range(300)]
    ix.build(vec)
    dense = np.zeros((300, 50))
    for d, (t, w) in enumerate(vec):
        dense[d, t] = w
    for d in range(0, 300, 11):
        c = dense @ dense[d]
        best = np.lexsort((np.arange(300), -np.round(c, 12)))[:7]
        assert ix.nearest(*vec[d])[0].tolist() == best[c[best] > 0].tolist()
    empty = toxicity.fit(docs, lab.limit(0), F.lit(True), label="y")
    assert {x["score"] for x in toxicity.score(docs, empty).collect()} == {0.0}


def test_toxicity_scores_do_not_depend_on_slices(spark, monkeypatch):
    docs, lab = _labelled(spark, "scumbag", "fine")
    index = toxicity.fit(docs, lab, F.col("doc_id") % 5 != 0, label="y")
    whole = sorted(map(str, toxicity.score(docs, index).collect()))
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert sorted(map(str, toxicity.score(docs, index).collect())) == whole


def test_toxicity_indexes_every_term(spark):
    """A language with three toxic examples keeps its terms (default values),
    and texts that only share a line are separate examples."""
    docs, lab = _labelled(spark, "scumbag", "fine")
    r = random.Random(4)
    few = [f"palabra{i}" for i in range(40)]
    rows = [(1000 + i, " ".join(r.choice(few) for _ in range(30)) + (" canalla canalla" if i % 4 == 0 else ""))
            for i in range(16)]
    line = "a line of five words that many texts hold"
    rows += [(2000 + i, f"{line} own{i}") for i in range(5)]
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    lab = lab.union(spark.createDataFrame([(i, int(i < 2000 and i % 4 == 0)) for i, _ in rows], "doc_id long, y int"))
    index = toxicity.fit(docs, lab, F.col("doc_id") != 1000, label="y")
    held = {x["doc_id"]: x for x in toxicity.score(docs, index).collect()}
    assert [e["label"] for e in held[1000]["evidence"][:3]] == [1, 1, 1]
    assert held[1000]["score"] > max(held[1000 + i]["score"] for i in range(16) if i % 4)
    assert set(range(2000, 2005)) <= set(index.ids.tolist())
    for _, text in rows[1:]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert (index.find(toxicity.terms(data, np.array([0, len(data)]))[0]) >= 0).all()


def test_heavy_terms_are_kept_once():
    """A term in the matrix has no postings beside it."""
    r = np.random.default_rng(3)
    vectors = [(np.append(0, 1 + r.choice(400, 5, replace=False)), r.random(6)) for _ in range(300)]
    index = toxicity.ToxicityIndex(np.arange(401, dtype=np.uint64), np.ones(401), np.arange(300), np.zeros(300))
    index.build(vectors)
    assert index.dense.shape[1] == 1 and len(index.doc) == len(index.weight) == 300 * 5
    full = np.zeros((300, 401))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    for t, w in vectors[:20]:
        d, s = index.nearest(t, w)
        assert np.allclose(s, np.sort(full[:, t] @ w)[::-1][:index.k].clip(max=1.0))


def test_toxicity_index_is_compact(spark):
    """Postings take the least integers, the matrix single precision; what is
    sent to tasks holds no matrix and no second copy of the examples' terms."""
    docs, lab = _labelled(spark, "scumbag", "fine")
    index = toxicity.fit(docs, lab, F.col("doc_id") % 5 != 0, label="y")
    assert index.dense is None
    assert index.doc.itemsize + index.weight.itemsize <= 4
    assert index.ready().dense.dtype == np.float32 and index.dense.shape[1] == len(index.heavy) > 0
    assert sum(v.nbytes for v in (index.doc, index.weight, index.held_column, index.held_weight)) <= 4 * index.held[-1] + 4 * index.start[-1]


def test_postings_of_equal_weight_are_one_run(monkeypatch):
    """A search multiplies once for all examples that hold a term equally
    often; their order is made in parts of any size."""
    r = np.random.default_rng(5)
    n = 200
    count = np.zeros((n, 300), int)
    for row in count:
        row[r.choice(300, 12, replace=False)] = r.integers(1, 4, 12)
    for size in (1 << 18, 7):
        monkeypatch.setattr(toxicity, "RUNS", size)
        index = toxicity.ToxicityIndex(np.arange(300, dtype=np.uint64), np.ones(300), np.arange(n), np.zeros(n))
        index.build([(np.flatnonzero(c), np.log1p(c[c > 0])) for c in count])
        light = index.column < 0
        assert len(index.weight) == sum(len(np.unique(c[c > 0])) for c in count.T[light]) < len(index.doc)
        for c in count[:30]:
            t = np.flatnonzero(c)
            w = np.log1p(c[t])
            d, s = index.nearest(t, w / 40)
            full = np.log1p(count[:, t]) @ (w / 40)
            assert np.allclose(s, np.sort(full)[::-1][:index.k].clip(max=1.0)) and np.allclose(full[d].clip(max=1.0), s)


def test_lm_score_brute_force(spark, docs):
    vocab, net = lm_score.fit(docs, size=50, one_in=2, rounds=2)
    got = lm_score.score(docs, vocab, net).collect()
    assert len(got) == docs.count()
    for r in docs.where("doc_id < 15").collect():
        h, _ = word_hashes(np.frombuffer((r["text"] or "").encode(), np.uint8), np.array([0, len((r["text"] or "").encode())]))
        tok = vocab.tokens(h).tolist()
        total = 0.0
        for p, t in enumerate(tok[:2000]):
            ctx = [tok[q] if 0 <= q < len(tok) else vocab.pad for q in (p - 2, p - 1, p + 1, p + 2)]
            hid = np.tanh(net.emb[ctx].reshape(-1) @ net.w1 + net.b1)
            z = (hid @ net.w2 + net.b2).astype(float)
            total += z[vocab.kind[t]] - math.log(np.exp(z).sum()) + vocab.within[t]
        own = next(x for x in got if x["doc_id"] == r["doc_id"])
        assert own["n_tokens"] == len(tok)
        if len(tok) <= 2000:
            assert own["log_prob"] == pytest.approx(total, rel=1e-4, abs=1e-6)
    assert lm_score.score(docs.limit(0), *lm_score.fit(docs.limit(0), size=5)).count() == 0


def test_lm_score_trains_on_every_position(spark):
    """Every word stands beside some position, so training on all of them
    moves the vector of every word."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(5))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None), (41, "")], "doc_id long, text string")
    vocab, net = lm_score.fit(docs)
    start = lm_score.Network.new(vocab.pad)
    assert len(vocab.words) == 200
    assert (net.emb[:200] != start.emb[:200]).any(1).all()
    ctx, y = zip(*lm_score.positions(lm_score.token_rows(docs, vocab, "doc_id", "text").toArrow().to_batches(), vocab, 1))
    assert sum(map(len, y)) == 200
    assert np.bincount(np.concatenate(y), minlength=64).tolist() == np.bincount(vocab.kind[:200], minlength=64).tolist()
    # a copy or a null id is trained on like any other document
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert lm_score.score(odd, *lm_score.fit(odd)).count() == 3


def test_search_recall_and_edges(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 24))
    x[50] = x[60]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), ann.fit(df)).collect()
    hit = 0
    for q in range(0, 700, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(700), d))[:10]
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11))
        assert all(abs(g["score"] - d[g["vec_id"]]) < 1e-12 for g in own)
        hit += len({g["vec_id"] for g in own} & set(best.tolist()))
    assert hit >= 0.9 * 350 and not [g for g in got if g["query_id"] >= 900]
    few = df.where("vec_id < 4")
    assert ann.search(few, few, ann.fit(few)).count() == 12
    assert ann.search(df.limit(0), df, ann.fit(df.limit(0))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, f in p.STAGES[:-1]:
        out = f(spark, kept, sf)
        assert out.columns == docs.columns
        assert out.join(kept.select("doc_id"), "doc_id", "left_anti").count() == 0
        kept = spark.createDataFrame(out.collect(), docs.schema)
    packed = p.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_pipeline_stages_ignore_columns_of_the_input(spark):
    import corpus_pipeline as p
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = docs.withColumns({"Score": F.lit(0.1), "_score": F.lit(0.9), "evidence": F.lit("x"), "n_lines": F.lit(1),
                              "n_dropped": F.lit(1), "kept": F.lit(False)})
    for _, f in p.STAGES[:3]:
        want, got = f(spark, docs, sf), f(spark, clash, sf)
        assert got.columns == clash.columns
        key = [F.col("doc_id"), F.col("text"), F.col("n_chars")]
        assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))
        assert got.where("Score <> 0.1 or _score <> 0.9 or n_lines <> 1 or n_dropped <> 1").isEmpty()
