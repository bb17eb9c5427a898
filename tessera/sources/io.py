"""Sources and sinks (SRC1-SRC6, SNK1-SNK2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import as_list
from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a
    machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """SRC1 / SRC2: CSV with header (schema inferred unless given), JSON
    records (JSON lines, or files that are each a JSON array), parquet."""
    fmt = fmt.lower()
    if fmt == "csv":
        r = spark.read.option("header", True)
        if schema is not None:
            return r.schema(schema).csv(path)
        df = r.option("inferSchema", True).csv(path)
        # inferred integers are 64-bit, as pandas reads them
        return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name)
                           if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f"`{f.name}`")
                           for f in df.schema.fields])
    if fmt == "json":
        r = spark.read.option("multiLine", _is_json_array(spark, path))
        if schema is not None:
            r = r.schema(schema)
        return r.json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r} (Excel: convert to CSV first)")


def _is_json_array(spark, path) -> bool:
    head = spark.read.text(path).limit(1).collect()
    return bool(head) and head[0][0].lstrip().startswith("[")


def validate_table(df: DataFrame) -> DataFrame:
    """SRC3: reject an empty table or one with fewer than 2 columns."""
    if len(df.columns) < 2:
        raise ValueError("the table needs at least 2 columns")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """SRC4: drop columns that are NULL in every row (one aggregate)."""
    if not df.columns:
        return df
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if row[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def unique_column_names(names: list[str]) -> list[str]:
    """SRC5: ``a, a, a -> a, a_1, a_2`` (suffixes skip names already taken)."""
    seen: dict[str, int] = {}
    taken = set()
    out = []
    for n in names:
        if n not in taken:
            out.append(n)
            taken.add(n)
            seen.setdefault(n, 0)
            continue
        k = seen.get(n, 0) + 1
        while f"{n}_{k}" in taken:
            k += 1
        seen[n] = k
        out.append(f"{n}_{k}")
        taken.add(f"{n}_{k}")
    return out


def unique_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_column_names(df.columns))


def preview(df: DataFrame, n: int = 10, keys=None):
    """SRC6: (row count, column count, first ``n`` rows by ``keys``). Spark
    has no positional order, so 'first' means smallest key."""
    keys = as_list(keys) or df.columns[:1]
    head = df.orderBy(*keys).limit(n)
    return df.count(), len(df.columns), head


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SNK1: CSV with a header, written in parallel (one file per task)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def export_report(reports: dict[str, DataFrame], path: str) -> str:
    """SNK2: each report table as JSON lines under ``path/<name>``."""
    for name, rep in reports.items():
        rep.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
    return path
