"""tessera: tabular preparation and modelling on Spark DataFrames.

Typical use::

    from tessera import clean, impute, outliers, encode, scale, prep, train
    df, report = clean.clean(raw)
    model = prep.Preprocessor({"target": "y", "scaling": "robust"}).fit(df)
    features = model.transform(new_rows)          # batch or streaming DataFrame
"""

__version__ = "0.1.0"

from tessera.operators import (  # noqa: E402,F401  (public modules)
    automl, browse, charts, clean, encode, evaluate, impute, noise, outliers, prep, profile,
    reports, scale, select, split, train,
)
from tessera.sources import io, stage  # noqa: E402,F401
from tessera.streaming import replay  # noqa: E402,F401
