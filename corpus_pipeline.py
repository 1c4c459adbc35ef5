"""A corpus pipeline over ``documents``: rules, line dedup, near-dedup, decontamination, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and reads again as the next stage's ``docs``.
All but the last return the columns of ``documents``.

Defined cases, in every stage: columns other than those of ``documents`` are left out; a
null text counts as an empty one, which the first stage rejects for want of words; a null
doc_id stands after all others where one document of a group stays, and rows of one doc_id
with different texts are different documents; identical rows are one document in
near_dedup; an empty table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import byte_bpe, decontamination, line_runs, repetition_rules, simhash_vptree
from loamspark.llm.common import checkpoint_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that a text needs, those of the first stage's base rule.
MIN_WORDS = repetition_rules.RepetitionLimits().min_words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition_rules.keep_by_repetition(docs.select(COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; what is left of a document goes too if it is under ``MIN_WORDS`` words and under a quarter of its words.

    A near copy loses all lines but the changed ones, which resemble nothing that the next
    stage could find. A document that keeps a quarter of its words stays, however short; one
    whose few own words stand among copied lines is taken for such a near copy.
    """
    words = lambda text: F.size(F.filter(F.split(F.coalesce(text, F.lit("")), line_runs.WORD_GAP, -1), lambda w: w != ""))
    marked = docs.select(*COLUMNS, words(F.col("text")).alias("n_words"))
    out = line_runs.dedup_lines(marked, runs_col="runs")
    touched, left = F.size("runs") > 0, words(F.col("text"))
    remnant = touched & (left < MIN_WORDS) & (4 * left < F.col("n_words"))
    return out.where(~remnant).select("doc_id", "text", "lang", "source", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id."""
    return simhash_vptree.keep_first_of_each(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs.select(COLUMNS), items)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, decoded again."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: DuckDB has no XXH64, so the rows have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
