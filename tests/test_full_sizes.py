"""Registered model queries run the operators at the reference's sizes."""

import inspect

import pytest

from tessera.catalog import QUERIES, q_impute, q_models


class Called(Exception):
    pass


@pytest.mark.parametrize("query, module, name, want", [
    ("noi3_detect_regression_noise", q_models.N, "detect_label_noise_regression", {"n_trees": 200}),
    ("sel6_rfe_forest", q_models.TR, "rfe", {"n_trees": 100}),
    ("trn12_multiclass_logistic", q_models.TR, "train_classification", {"models": None}),
    ("imp6_iterative_multivariate", q_impute.I, "impute_iterative", {"max_iter": 10}),
])
def test_query_sizes(spark, monkeypatch, query, module, name, want):
    operator = getattr(module, name)

    def seen(*args, **kwargs):
        got = inspect.signature(operator).bind(*args, **kwargs)
        got.apply_defaults()
        assert {k: got.arguments[k] for k in want} == want
        raise Called

    monkeypatch.setattr(module, name, seen)
    with pytest.raises(Called):
        QUERIES[query](spark, "/root/testdata/sf0.001")
