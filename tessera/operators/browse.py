"""Table browsing (TBL1-TBL2): search and sort as distributed plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import as_list
from tessera.plans.ranks import global_row_number


def search_rows(df: DataFrame, query: str) -> DataFrame:
    """TBL1: rows where any cell's text contains ``query``, ignoring case.
    A per-row filter: pushed into the scan stage, no shuffle."""
    q = query.lower()
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False))
    return df.where(cond)


def sort_rows(df: DataFrame, col: str, ascending: bool = True, keys=None) -> DataFrame:
    """TBL2: order by one column: cells that parse as numbers first, by
    value, then the rest by text; ``keys`` break ties. Adds ``position``
    (0-based) computed with a distributed global rank, so sorting a large
    table never funnels through one task."""
    num = F.col(col).cast("string").try_cast("double")
    d = df.withColumn("__num", num).withColumn("__txt", F.col(col).cast("string"))
    d = d.withColumn("__isnum", F.col("__num").isNotNull().cast("int"))
    order = [("__isnum", False), ("__num", ascending), ("__txt", ascending)] + [(k, True) for k in as_list(keys)]
    ranked = global_row_number(d, order, out="position")
    return ranked.select(*df.columns, "position")
