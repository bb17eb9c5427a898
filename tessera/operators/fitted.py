"""Base classes for our fitted stages: an ML ``Estimator`` whose ``Model``
holds a small JSON state (fill values, code maps, bounds, names). The state
is learned from aggregates; ``transform`` is a single projection with
literals, so it is map-only and valid on streaming DataFrames. Save / load
go through Spark ML's params metadata; tables that the state names (codes of
columns with very many categories) are copied below the saved model, so it
does not depend on the scratch folder of the session that fitted it.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReader, MLWriter)
from pyspark.sql import SparkSession


class JsonParams(Params):
    config = Param(Params._dummy(), "config", "stage configuration as JSON",
                   typeConverter=TypeConverters.toString)

    def _init_config(self, config):
        self._setDefault(config="{}")
        if config is not None:
            self._set(config=json.dumps(config, sort_keys=True, default=str))

    @property
    def conf(self) -> dict:
        return json.loads(self.getOrDefault(self.config))


def _tables(state, swap):
    """``state`` with every value of a key ``table`` replaced by ``swap`` of it."""
    if isinstance(state, dict):
        return {k: swap(v) if k == "table" and isinstance(v, str) else _tables(v, swap) for k, v in state.items()}
    return [_tables(v, swap) for v in state] if isinstance(state, list) else state


class _StateWriter(MLWriter):
    def __init__(self, model: "JsonStateModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        found: list[str] = []

        def take(table: str) -> str:
            found.append(table)
            return f"@{len(found) - 1}"

        state = _tables(self.model.fitted, take)
        model = self.model.copy()
        model._set(state=json.dumps(state, default=str))
        DefaultParamsWriter.saveMetadata(model, path, spark)
        for i, table in enumerate(found):
            spark.read.parquet(table).write.parquet(f"{path}/tables/{i}")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        state = _tables(model.fitted, lambda t: f"{path}/tables/{t[1:]}" if t.startswith("@") else t)
        model._set(state=json.dumps(state, default=str))
        return model


class JsonStateModel(Model, JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted state as JSON",
                  typeConverter=TypeConverters.toString)

    def __init__(self, config=None, state=None):
        super().__init__()
        self._init_config(config)
        self._setDefault(state="{}")
        if state is not None:
            self._set(state=json.dumps(state, default=str))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class JsonEstimator(Estimator, JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, config=None):
        super().__init__()
        self._init_config(config)
