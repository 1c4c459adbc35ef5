"""Queries of the classifiers and of token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import rule_ensemble, toxicity, viterbi_counts
from loamspark.llm.common import crc32_text, read_table


def _training(labels: DataFrame, label: str, parts: int, held_out: int) -> DataFrame:
    """doc_id, label of the rows that may be learnt from."""
    return labels.where(F.pmod(crc32_text(F.col("doc_id")), F.lit(parts)) != held_out).select("doc_id", F.col(label).alias("label"))


def _held_out(scored: DataFrame, parts: int, remainder: int) -> DataFrame:
    held = F.pmod(crc32_text(F.col("doc_id")), F.lit(parts)) == remainder
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _held_out(rule_ensemble.classify_quality(docs, _training(labels, "quality", 4, 2)), 4, 2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return viterbi_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _held_out(toxicity.classify_toxicity(docs, _training(labels, "toxic", 5, 0)), 5, 0)


QUERIES = {"op4_rule_ensemble": op4_rule_ensemble, "op7_token_counts": op7_token_counts, "op8_toxicity": op8_toxicity}
