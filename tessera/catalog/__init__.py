"""Registered queries over the driver's test tables: one per inventory ID,
each with the DuckDB SQL that states the same result from the formula."""

from tessera.catalog.registry import ORACLE, QUERIES, register  # noqa: F401
from tessera.catalog import (  # noqa: F401  (registration side effects)
    q_charts_eval,
    q_encode,
    q_impute,
    q_models,
    q_outliers,
    q_profile,
    q_scale_select,
    q_sources,
)
