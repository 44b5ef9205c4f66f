"""Query op11: spelling variants of the words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import spelling
from .common import spread

#: Fixed value. One run in so many loses a code point, which plants misspellings.
DROP_EVERY = 31


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent form, root and near words of every word of documents."""
    return spelling.spelling_variants(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), drop_every=DROP_EVERY)


QUERIES = {"op11_spelling": op11_spelling}
#: crc32 has no SQL; the tests hold the query against brute force.
ORACLE: dict[str, str] = {}
