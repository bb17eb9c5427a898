"""Fitted transforms give the same rows on a stream as on a batch."""

import pandas as pd

from tessera.operators import encode as E
from tessera.operators import impute as I
from tessera.operators import scale as S
from tessera.streaming.replay import replay_stream


def test_fitted_stages_batch_equals_stream(spark, tmp_path):
    pdf = pd.DataFrame({"k": range(60),
                        "x": [float(i % 9) if i % 7 else None for i in range(60)],
                        "c": [["a", "b", "c", "d"][i % 4] if i % 5 else None for i in range(60)]})
    src = tmp_path / "in"
    spark.createDataFrame(pdf).repartition(3).write.parquet(str(src))
    batch_in = spark.read.parquet(str(src))
    imp = I.Imputer({"exclude": ["k"]}).fit(batch_in)
    enc = E.Encoder({"columns": {"c": "onehot"}}).fit(imp.transform(batch_in))
    sc = S.Scaler({"columns": ["x"], "method": "robust"}).fit(imp.transform(batch_in))

    def chain(d):
        return sc.transform(enc.transform(imp.transform(d)))

    batch = sorted(map(tuple, chain(batch_in).collect()))
    stream = replay_stream(spark, chain, str(src), batch_in.schema,
                           out_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"),
                           max_files_per_trigger=1)
    assert sorted(map(tuple, stream.select(*chain(batch_in).columns).collect())) == batch
