"""Planner paths that only trigger at scale, forced on small inputs."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tessera.plans import stats as S
from tessera.plans.ranks import global_row_number, running_totals


def _df(spark, values, name="x"):
    return spark.createDataFrame(pd.DataFrame({name: values}))


def test_quantiles_selection_path_matches_numpy(spark):
    rng = random.Random(7)
    vals = [rng.gauss(0, 1) for _ in range(5000)] + [3.0] * 700 + [None] * 50
    df = _df(spark, vals)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    exact = S.quantiles(df, ["x"], probs)["x"]
    forced = S.quantiles(df, ["x"], probs, exact_distinct_limit=0, accuracy=100, collect_limit=50)["x"]
    ref = np.quantile(np.array([v for v in vals if v is not None]), probs)
    for a, b, r in zip(exact, forced, ref):
        assert math.isclose(a, r, rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(b, r, rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_all_null_and_single(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    q = S.quantiles(df, ["a", "b"], [0.25, 0.5])
    assert q["a"] == [None, None]
    assert q["b"] == [1.0, 1.0]


def test_modes_ties_smallest(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 2, 1.5), ("a", 1, 2.5), ("b", 1, 2.5), (None, None, None)],
                               "s string, n int, d double")
    assert S.modes(df, ["s", "n", "d"]) == {"s": "a", "n": 1, "d": 1.5}


def test_distinct_counts_cap(spark):
    df = spark.range(0, 5000).selectExpr("id", "id % 3 AS small", "CAST(NULL AS INT) AS empty")
    got = S.distinct_counts(df, ["id", "small", "empty"], cap=10)
    assert got["small"] == 3 and got["empty"] == 0 and got["id"] > 100
    assert S.distinct_counts(df, ["id"])["id"] == 5000


def test_global_row_number_matches_sort(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    out = global_row_number(df, ["v", "k"], out="r", partitions=7).collect()
    expect = {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    assert {r["k"]: r["r"] for r in out} == expect


def test_running_totals_by_group(spark):
    rows = [(g, s, 1) for g in range(3) for s in range(200)]
    df = spark.createDataFrame(rows, "g int, s int, v int")
    out = running_totals(df, ["s"], ["v"], group_cols=["g"], partitions=5).collect()
    assert all(r["cum_v"] == r["s"] + 1 for r in out)


def test_grouped_quantiles_both_paths_match_pandas(spark):
    rng = random.Random(11)
    rows = [(g, rng.gauss(i, 1.0)) for i, g in enumerate("abc") for _ in range(700)] + [("d", 1.0), ("d", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ref = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].quantile([0.25, 0.5, 0.75]).unstack()
    for limit in (10_000_000, 100):        # grouped percentile / masked bracket refinement
        got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in
               S.grouped_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], exact_distinct_limit=limit,
                                   accuracy=100, collect_limit=50).collect()}
        for g in "abcd":
            assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(got[g], ref.loc[g]))


def test_global_rank_splits_a_hot_value(spark):
    from tessera.plans.ranks import _bucketed, _spec
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(6000)]          # value 7 holds a third
    df = spark.createDataFrame(rows, "k long, v long")
    b = _bucketed(df, _spec(["v", "k"]), 8)
    hot_buckets = b.where("v = 7").select("__bkt").distinct().count()
    assert hot_buckets > 1
    out = global_row_number(df, [("v", False), ("k", True)], out="r", partitions=8).collect()
    expect = {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])))}
    assert {r["k"]: r["r"] for r in out} == expect


def test_wide_table_modes_and_counts_chunked(spark):
    cols = [f"c{i}" for i in range(70)]                 # more than one union chunk
    rows = [tuple((r * (i + 1)) % 3 for i in range(70)) for r in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    nun = S.distinct_counts(df, cols)
    md = S.modes(df, cols)
    for i, c in enumerate(cols):
        vals = [row[i] for row in rows]
        assert nun[c] == len(set(vals))
        counts = {v: vals.count(v) for v in set(vals)}
        assert md[c] == min(v for v in counts if counts[v] == max(counts.values()))


def test_large_sums_reach_the_driver_once(spark, monkeypatch):
    """Arrays of many tasks are added in tasks, slice by slice."""
    from tessera.plans import passes
    df = spark.range(0, 1000, 1, 6)
    make = lambda batches: sum(np.outer(np.ones(50), np.asarray(b.column("id"))).sum(1) * np.arange(50) for b in batches)
    sent = []
    got = passes.summed(df, make, 50)
    monkeypatch.setattr(passes, "DIRECT_MB", 0)
    monkeypatch.setattr(passes, "SLICE_KB", 0)
    to_arrow = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: sent.append(to_arrow(self)) or sent[-1])
    again = passes.summed(df, make, 50)
    assert np.array_equal(got, again) and np.array_equal(got, 499500.0 * np.arange(50))
    assert sum(len(v.as_py()) for t in sent for v in t["v"]) == 8 * 50
