"""Queries of the training-data operators, one opN_<name> each, and their SQL where DuckDB can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import collision, jaccard, knnjoin, licences, linededup, mixing, ngramlm, pieces, ppm, toxicity
from stratakv.llm.oracles import oracle_sql
from stratakv.llm.textio import fold_of
from stratakv.sources.shipping import ship


__all__ = ["oracle_sql", "queries"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose_share(text: str = "text"):
    """Share of a text's characters that are letters or blanks, as a document's quality."""
    return F.length(F.regexp_replace(text, r"[^\p{L} ]+", "")) / F.greatest(F.length(text), F.lit(1)) + 0.01


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 7) == 2)
    return ngramlm.score(docs, ngramlm.learn(docs.where(~F.col("held_out"))), ("doc_id", "held_out"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality=prose_share())


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knnjoin.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


#: The public SentencePiece model that texts are encoded with.
PIECES = os.environ.get("STRATAKV_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, PIECES, ("doc_id",))
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"), F.length("decoded").cast("long").alias("decoded_chars"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    kept = linededup.dedup_lines(docs)
    return kept.select("doc_id", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1)
    model = toxicity.learn(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 3) != 1))
    return toxicity.score(docs, model, ("doc_id", "held_out"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.learn(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
    return ppm.identify(docs, ppm.learn(docs.where(~F.col("held_out"))), ("doc_id", "held_out"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_lm_score, op2_mix_sources, op3_exact_top_k, op4_ngram_jaccard, op5_sentencepiece, op6_line_dedup, op7_nearest, op8_toxicity, op9_licences, op10_language)
    return {f.__name__: f for f in named}
