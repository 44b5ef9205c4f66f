"""Queries op1 and op2: quality and toxicity scores of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier, toxicity
from .common import held_out, spread


def _contract(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs, labels = (spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("documents", "labels"))
    return _contract(quality_classifier.score(docs, labels, held_out(F.col("id"), 3, 1)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and the examples nearest to it."""
    docs, labels = (spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("documents", "labels"))
    return _contract(toxicity.score(docs, labels, held_out(F.col("id"), 5, 0)), "neighbours", "cosines")


QUERIES = {"op1_quality_classifier": op1_quality_classifier, "op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
