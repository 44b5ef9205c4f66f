"""Query op13: whitened embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import whitening
from .common import spread


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every embedding."""
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitening.whitened(vectors).withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("id", "vec_id")


QUERIES = {"op13_whitening": op13_whitening}
#: Eigenvectors have no SQL; the tests hold the query against brute force.
ORACLE: dict[str, str] = {}
