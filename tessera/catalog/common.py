"""Shared derived tables for the registered queries (built the same way in
Spark and in the oracle SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog.registry import table

R = 6  # decimals kept on computed doubles on both sides


def round_doubles(df: DataFrame, digits: int = R) -> DataFrame:
    """Round every double column (oracle comparisons hash values)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def docs_missing(spark, d) -> DataFrame:
    """documents LEFT JOIN labels with NULLs at several rates:
    n_chars 14.5 %, doc_rank 5 %, chars_en 38 %, quality / toxic 60.1 %,
    lang 12.9 %, source 5 % (sf 0.01)."""
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    return j.select(
        "doc_id",
        F.when(F.col("lang") != "fr", F.col("n_chars")).alias("n_chars"),
        F.when(F.col("source") != "src1", F.col("doc_id")).alias("doc_rank"),
        F.when(F.col("lang") == "en", F.col("n_chars") / 10).alias("chars_en"),
        "quality", "toxic",
        F.when(F.col("lang") != "de", F.col("lang")).alias("lang"),
        F.when(F.col("source") != "src0", F.col("source")).alias("source"))


DOCS_MISSING_SQL = """
dm AS (
  SELECT d.doc_id,
         CASE WHEN d.lang <> 'fr' THEN d.n_chars END AS n_chars,
         CASE WHEN d.source <> 'src1' THEN d.doc_id END AS doc_rank,
         CASE WHEN d.lang = 'en' THEN d.n_chars / 10 END AS chars_en,
         l.quality, l.toxic,
         nullif(d.lang, 'de') AS lang,
         nullif(d.source, 'src0') AS source
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""

# (name, duckdb type label as Spark prints it, numeric?)
DM_COLUMNS = [("doc_id", "bigint", True), ("n_chars", "bigint", True), ("doc_rank", "bigint", True),
              ("chars_en", "double", True), ("quality", "int", True), ("toxic", "int", True),
              ("lang", "string", False), ("source", "string", False)]


def sql_mode(col: str, rel: str) -> str:
    """Most frequent non-null value, ties -> smallest."""
    return (f"(SELECT {col} FROM {rel} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


def lineitem_typed(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                     "l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("is_open"))


def exact_line_total():
    """sum(price * (1 - discount) * (1 + tax)) in DECIMAL, so the total does
    not depend on summation order (identical in Spark and the oracle)."""
    d = lambda c: F.col(c).cast("decimal(15,2)")
    return F.sum(d("l_extendedprice") * (1 - d("l_discount")) * (1 + d("l_tax"))).cast("double")
