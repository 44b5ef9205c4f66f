"""Query op7: language-model scores of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lm_scoring
from .common import spread


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return lm_scoring.score(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_lm_score": op7_lm_score}
ORACLE: dict[str, str] = {}
