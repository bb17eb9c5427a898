"""Phrase mining against its SQL and brute force on odd texts."""

import re
from collections import Counter

import pytest

from oracle_util import compare, duck
from tessera.llm import phrases
from tessera.llm.queries import ORACLE, QUERIES


def test_query_against_sql(spark, sf_dir):
    name = "op12_phrase_collocations"
    assert not compare(spark, duck(sf_dir), QUERIES[name], ORACLE[name], sf_dir)


def _brute(rows, longest, least, top, share):
    f, langs = {}, {}
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i:i + m])] += 1
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        out = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cand.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]])
                                        for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p).encode(), left, right))
        langs[lang] = [(lang, i + 1, ph.decode(), -a, left, right, n, -s)
                       for i, (s, a, ph, left, right) in enumerate(sorted(out)[:top])]
    return sorted(r for v in langs.values() for r in v)


ODD = ([("New York is big. NEW york, new York; a b c d", "en")] * 6 + [("a b c d e a b c d e\ta b\x0bc d", None)] * 5
       + [("a b c d", "und"), ("en es en es", "en"), ("en es en es", "es"), ("es en es en", "es"), (None, "en"), ("", "en"),
          (" \t ", "de"), ("...", "de"), ("É É É É é é", "fr"), ("x " * 30000 + "." + "y z " * 20000, "long"),
          ("one\xa0word one\xa0word one\xa0word", "fr")])


@pytest.mark.parametrize("longest,least,top,share", [(3, 3, 2000, 50), (2, 1, 3, 50), (4, 2, 2000, 80), (5, 4, 7, 10)])
def test_odd_texts_against_brute_force(spark, longest, least, top, share):
    df = spark.createDataFrame([(t, la, 1, "z") for t, la in ODD], "text string, lang string, rank int, phrase string")
    got = phrases.collocations(df.repartition(5), longest, least, top, share)
    rows = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert rows == _brute(ODD, longest, least, top, share)


def test_slices_end_with_pieces(spark, monkeypatch):
    import numpy as np
    data = np.frombuffer(("a b c. " * 50 + "d " * 300 + "; e f").encode(), np.uint8)
    monkeypatch.setattr(phrases, "SLICE", 64)
    cuts = list(phrases._stretches(data))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data)
    assert all(a[1] == b[0] and data[a[1] - 1] in b".;" for a, b in zip(cuts, cuts[1:]))


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
