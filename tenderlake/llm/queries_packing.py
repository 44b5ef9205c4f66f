"""Query op4: documents packed into windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import packing
from .common import spread


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_packing": op4_packing}
ORACLE: dict[str, str] = {}
