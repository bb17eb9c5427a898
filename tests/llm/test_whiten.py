"""Whitening: solver against numpy, query against a brute-force version."""

from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whiten
from tessera.llm.queries import QUERIES


@pytest.mark.parametrize("kind", ["random", "equal", "two levels", "low rank", "close", "none"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 90)), rng.normal(size=(30, 3))
    v = {"random": a @ a.T, "equal": 3 * np.eye(12), "two levels": np.diag([5.0] * 11 + [1.0] * 7), "low rank": b @ b.T,
         "close": np.diag(1 + 1e-9 * np.arange(25)), "none": np.zeros((5, 5))}[kind]
    e, y = whiten.leading(v, 8)
    true = np.linalg.eigvalsh(v)[::-1]
    assert len(e) == {"low rank": 3, "none": 0}.get(kind, 8)
    assert np.allclose(e, true[:len(e)], rtol=1e-13, atol=1e-13 * max(true[0], 1))
    assert np.allclose(y.T @ y, np.eye(len(e)), atol=1e-13)
    assert np.abs(v @ y - y * e).max(initial=0) <= 1e-12 * max(true[0], 1)


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a = rng.normal(size=(15, 15))
        a = a + a.T
        np.fill_diagonal(a, 0)   # needs 2x2 pivots
        e = np.linalg.eigvalsh(a)
        assert whiten.inertia(a) == ((e < 0).sum(), (e > 0).sum())


def test_large_values_stay_exact():
    y = np.random.default_rng(5).integers(-(1 << 40), 1 << 40, size=(2500, 3))
    o = y.astype(object)
    assert (whiten._gram(y) == o.T @ o).all()


def _brute(ids, x):
    """Rows of the contract from integers, by numpy's eigensolver."""
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    dev = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x]
    return dict(zip(ids, zip(dev, c @ u / np.sqrt(e)))), e / np.trace(c.T @ c / n), n


def test_query_against_brute_force(spark, sf_dir):
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir).toPandas()
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(raw["embedding"]).astype(float)).astype(np.int64) + 100000
    want, share, n = _brute(raw["vec_id"], x)
    assert len(got) == 8 * n and (got["n"] == n).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    true = np.stack([want[i][1] for i in wide.index])
    sign = np.sign((wide.to_numpy() * true).sum(0))
    assert np.allclose(wide.to_numpy() * sign, true, atol=1e-9)
    assert (got["deviation"] == got["vec_id"].map(lambda i: want[i][0])).all()
    assert np.allclose(got["explained"], share[got["component"] - 1], rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], [-3.0, 1.0, 2.0], [4.0, -2.0, 1e6], [1.0, 2.0, 0.5]]
    rows = [(i, v) for i, v in enumerate(good)] + [(4, good[4]), (None, [9.0, 9.0, 1.0]), (10, None), (11, [1.0, None, 2.0]),
                                                   (12, [nan, 1.0, 1.0]), (13, [inf, 1.0, 1.0]), (14, [1.0, 2.0]), (15, []),
                                                   (16, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, whitened string, n int")
    got = whiten.components(df).toPandas()
    x = np.floor(1024 * np.array(good + [good[4], [9.0, 9.0, 1.0]])).astype(np.int64) + 100000
    assert len(got) == 7 * 3 and (got["n"] == 7).all()
    s = x.sum(0)
    dev = sorted(int(sum((7 * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x)
    assert sorted(int(v) for v in got[got["component"] == 1]["deviation"]) == dev
    assert got["identity_error"][0] < 1e-4 and got["vec_id"].isna().sum() == 3
    shares = [Fraction(0)] + [Fraction(v) for v in got.groupby("component")["explained"].first()]
    assert abs(float(sum(shares)) - 1) < 1e-12


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.components(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whiten.components(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)
    assert whiten.components(line).where("component = 1").count() == 5 == whiten.components(line).count()
