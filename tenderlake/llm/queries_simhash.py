"""Query op6: SimHash near-duplicates of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import spread


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = simhash.near_duplicates(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLE: dict[str, str] = {}
