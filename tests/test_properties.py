"""Results must not depend on how the input is partitioned, and fitted
stages must replay exactly what ``fit`` + ``transform`` produced."""

import pandas as pd

from tessera.operators import encode as E
from tessera.operators import impute as I
from tessera.operators import outliers as O
from tessera.operators.prep import Preprocessor
from tessera.plans import stats as S


def _table(spark):
    rows = [(i, float((i * 37) % 101) if i % 13 else None, ["x", "y", "z", None][i % 4], (i * 7) % 5)
            for i in range(400)]
    return spark.createDataFrame(rows, "k long, v double, s string, n int")


def test_statistics_independent_of_partitioning(spark):
    df = _table(spark)
    a = (S.quantiles(df, ["v"], [0.1, 0.5, 0.9]), S.modes(df, ["s", "n"]), S.distinct_counts(df, ["v", "s"]))
    many = df.repartition(13)
    b = (S.quantiles(many, ["v"], [0.1, 0.5, 0.9]), S.modes(many, ["s", "n"]), S.distinct_counts(many, ["v", "s"]))
    assert a == b


def test_outliers_independent_of_partitioning(spark):
    df = _table(spark)
    one = O.outlier_details(df.coalesce(1), keys="k", exclude="k").orderBy("k", "column_name").collect()
    many = O.outlier_details(df.repartition(9), keys="k", exclude="k").orderBy("k", "column_name").collect()
    assert one == many


def test_fitted_stages_replay_fit_transform(spark):
    df = _table(spark)
    imp = I.Imputer({"exclude": ["k"]}).fit(df)
    direct = I.impute(df.drop("k"), rule="pipeline")
    replay = imp.transform(df).drop("k")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, replay.collect()))
    enc = E.Encoder({"columns": {"s": "ordinal"}}).fit(df)
    again = E.EncoderModel(config=enc.conf, state=enc.fitted)
    assert enc.transform(df).orderBy("k").collect() == again.transform(df).orderBy("k").collect()
    model, fitted_out = Preprocessor({"target": "n"}).fit_transform(df)
    replay = model.transform_keep_target(df)
    assert sorted(map(tuple, fitted_out.collect())) == sorted(map(tuple, replay.collect()))
