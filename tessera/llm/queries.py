"""Registered queries of the subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (ann, embed_dedup, html_text, line_dedup, lm_score, minhash_dedup, mixing, packing, phrases,
                         piece_bpe, quality, toxicity, whiten)
from tessera.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@register("op1_minhash_dedup")
def op1(spark, d):
    return minhash_dedup.near_duplicates(table(spark, d, "documents"), words=4)


@register("op2_html_text")
def op2(spark, d):
    return html_text.extract(table(spark, d, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op3_quality_classifier")
def op3(spark, d):
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"), _crc_mod(5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (_crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op4_packing")
def op4(spark, d):
    cut = packing.pieces(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(cut)


@register("op5_line_dedup")
def op5(spark, d):
    return line_dedup.dedup(table(spark, d, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@register("op6_toxicity")
def op6(spark, d):
    docs = table(spark, d, "documents")
    index = toxicity.fit(docs, table(spark, d, "labels"), _crc_mod(3) != 1)
    return toxicity.score(docs, index).select(
        "doc_id", (_crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "evidence")


@register("op7_lm_score")
def op7(spark, d):
    docs = table(spark, d, "documents")
    return lm_score.score(docs, *lm_score.fit(docs))


@register("op8_embedding_dedup")
def op8(spark, d):
    return embed_dedup.near_duplicates(table(spark, d, "embeddings"))


@register("op9_sentencepiece")
def op9(spark, d):
    got = piece_bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op10_nearest_neighbours")
def op10(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.where(F.col("vec_id") % 100 == 0)
    return ann.search(vectors, asked, ann.fit(vectors))


@register("op11_embedding_whitening")
def op11(spark, d):
    got = whiten.components(table(spark, d, "embeddings"), k=8)
    return got.withColumn("deviation", F.expr("try_cast(deviation as long)"))


@register("op12_phrase_collocations", oracle=phrases.SQL)
def op12(spark, d):
    return phrases.collocations(table(spark, d, "documents"))


@register("op13_source_mixing", oracle=mixing.SQL)
def op13(spark, d):
    return mixing.taken(mixing.plan(table(spark, d, "documents")))
