"""Every registered query against its DuckDB oracle (as the driver does),
and every rows-only query at least runs."""

import math

import pytest

import __spark_entry__ as E
from oracle_util import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()
UNIT = {"accuracy", "precision", "recall", "f1", "roc_auc", "confidence", "importance"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, sf_dir, name):
    problems = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_runs(spark, sf_dir, name):
    """Without SQL: the result has rows and typed, named columns, no number
    is infinite or NaN, and shares and scores stay within their range."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert (rows or name == "noi9_disagreement_noise") and len(set(df.columns)) == len(df.columns)
    assert all(t != "void" for _, t in df.dtypes)
    for c, t in df.dtypes:
        values = [r[c] for r in rows if r[c] is not None]
        if t == "double":
            assert all(math.isfinite(v) for v in values), c
        if c in UNIT:
            assert all(0 <= v <= 1 for v in values), c
        if c.endswith("_pct"):
            assert all(0 <= v <= 100 for v in values), c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["column_name", "lower_bound", "upper_bound", "below_lower",
                          "above_upper", "values_capped"]
