"""Query op5: repeated passages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import substring_dedup
from .common import spread


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return substring_dedup.passages(docs).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE: dict[str, str] = {}
