"""Corpus pipeline: quality classifier, toxicity, line dedup, MinHash
near-dedup, packing. Each stage reads the rows its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash_dedup, packing, quality, toxicity
from tessera.llm.common import free_name, stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; all labelled ones train."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = free_name("_stage_score", docs.columns)
    kept = quality.score(docs, model, keep_columns=tuple(docs.columns), out=name)
    return kept.where(F.col(name) >= 0.3).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name, why = (free_name(c, docs.columns) for c in ("_stage_score", "_stage_evidence"))
    kept = toxicity.score(docs, index, keep_columns=tuple(docs.columns), out=(name, why))
    return kept.where(F.col(name) < 0.7).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document left without any line
    goes, one that had none before stays. n_chars follows the text."""
    total, lost = (free_name(c, docs.columns) for c in ("_stage_lines", "_stage_dropped"))
    got = line_dedup.dedup(docs, out=(total, lost)).where((F.col(lost) == 0) | (F.col(lost) < F.col(total)))
    n_chars = F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5 words, 0.8), the one
    of least id; rows without an id stay."""
    found = minhash_dedup.near_duplicates(docs)
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in 2048-token sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [("quality classifier", quality_stage), ("toxicity", toxicity_stage), ("line dedup", line_stage),
          ("minhash near-dedup", near_dup_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # trained models and tokenizer ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are a staged table."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
