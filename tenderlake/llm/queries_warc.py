"""Query op10: pages as WARC bundles, read back, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and payload of the record of every page, read by its place in the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path, _ = warc.write_archives(pages)
    kind = pages.schema["page_id"].dataType
    return warc.read_by_index(spark, path).select(
        F.col("page").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


QUERIES = {"op10_warc": op10_warc}
ORACLE = {
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (
  SELECT hex, g, sum((position(substr(hex, (5 * g + b) // 4 + 1, 1) IN '0123456789abcdef') - 1) // (1 << (3 - (5 * g + b) % 4)) % 2 * (1 << (4 - b)))::INT AS v
  FROM (SELECT DISTINCT hex FROM p), range(32) AS r(g), range(5) AS s(b) GROUP BY hex, g),
b32 AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY g) AS digest FROM digits GROUP BY hex),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f ON p.hex = f.hex JOIN b32 ON p.hex = b32.hex
"""
}
