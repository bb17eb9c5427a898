"""Source mixing against its SQL; schedule, blocks and odd rows."""

from collections import defaultdict

import pytest

from oracle_util import compare, duck
from tessera.llm import mixing
from tessera.llm.queries import ORACLE, QUERIES


def test_query_against_sql(spark, sf_dir):
    name = "op13_source_mixing"
    assert not compare(spark, duck(sf_dir), QUERIES[name], ORACLE[name], sf_dir)


def _targets(sizes, weights, repeats):
    free, total = dict(zip(sizes, weights)), sum(sizes.values())
    capped = {}
    while True:
        over = {s for s, w in free.items() if w * (total - sum(capped.values())) > repeats * sizes[s] * sum(free.values())}
        if not over:
            left = total - sum(capped.values())
            return {**capped, **{s: left * w / sum(free.values()) for s, w in free.items()}}
        for s in over:
            capped[s] = float(repeats * sizes[s])
            del free[s]


@pytest.fixture(scope="module")
def rows():
    out = [(i, "w " * (i % 41), "abcde"[i % 5]) for i in range(900)]
    out += [(10000 + i, "v " * 13, "hot") for i in range(1500)] + [(20000, "u " * 9, "tiny"), (20001, "", "none"),
            (20002, None, None), (20003, "t\tt\nt", None), (None, "s s", "a"), (None, "s s", "a"), (5, "w " * 5, "a")]
    return out


def test_mix_keeps_targets_and_order(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, size int, taken string")
    mix = mixing.plan(df, block=64)
    got = mixing.taken(mix).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = _targets({s: sizes[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    pieces = mixing.mixed(mix).toPandas()
    by = pieces.fillna({"source": "<none>"}).groupby("source")["length"].sum()
    for s in order:
        assert by.get(s if s is not None else "<none>", 0) == int(want[s])
    # slots are full but for the ends of passes, and pieces fill them without a gap
    for _, slot in pieces.fillna({"source": "<none>"}).groupby(["slot", "source"]):
        slot = slot.sort_values("place")
        assert (slot["place"].to_numpy() == slot["length"].cumsum().shift(fill_value=0).to_numpy()).all()
        assert slot["length"].sum() <= 64
    # every stretch of the schedule holds a source near its share
    total = sum(int(v) for v in want.values())
    slots = mixing.slots(mix).toPandas().sort_values("slot")
    hot = (slots["source"] == "hot").cumsum().to_numpy()
    share = int(want["hot"]) / total
    inside = slots["slot"].to_numpy() < total // 64
    assert abs(hot - share * (slots["slot"].to_numpy() + 1))[inside].max() < 4


def test_reruns_and_partitions_agree(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(str, mixing.taken(mixing.plan(d)).collect())) for d in (df, df.repartition(17, "text")))
    assert a == b


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.plan(none)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.taken(mixing.plan(blank)).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_points_are_golden_ratio_multiples(spark):
    at = [0, 1, 2, 12345, 1 << 31, (1 << 40) + 7]
    df = mixing._points(spark.createDataFrame([(i,) for i in at], "slot long"))
    assert [r["point"] for r in df.collect()] == [i * mixing._PHI % (1 << 32) for i in at]
