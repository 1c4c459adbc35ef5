"""Queries over the shop's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamspark.llm import erasure
from loamspark.llm.common import read_table


def op12_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables as sorted files in a new folder, and what is left of each file after the erasure."""
    return erasure.erase(spark, {t.name: read_table(spark, sf_dir, t.name) for t in erasure.CASCADE})


QUERIES = {"op12_cascading_erasure": op12_cascading_erasure}
