"""Stored packets, sectioned texts, reports and manifests: scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind

PACKET = """portal string, id string, title string, organization string, posted_date string,
relevance struct<is_relevant:boolean,needs_review:boolean,confidence:double,category:string,reasons:array<string>,notes:array<string>>,
classification string, classification_source string, reviewed boolean, reviewed_at timestamp, work_status string, has_requirements boolean"""
REPORT = """scan_id string, portal string, started_at timestamp, finished_at timestamp, complete boolean, completion_reason string,
counts struct<discovered:int,processed:int,product:int,review:int,not_relevant:int,already:int,errors:int,downloads:int>"""


def packets(spark: SparkSession, directory: str, schema: str = PACKET) -> DataFrame:
    """Packets in files named by a storage id; other JSON in the folder is ignored, unreadable files are dropped.

    The id of a row is that of its file.
    """
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(directory)
    return stored_rows(rows.filter(F.col("_corrupt").isNull()).drop("_corrupt"), F.col("_metadata.file_name"))


def stored_rows(rows: DataFrame, file_name: Column) -> DataFrame:
    """The rows whose file is named by a storage id, with that ``storage_id``."""
    named = rows.withColumn("storage_id", F.regexp_extract(file_name, r"^(.*)\.json$", 1))
    return named.filter(F.col("storage_id").rlike("^([0-9]+|legacy-[0-9]+)$"))


def text_sections(texts: DataFrame, key: str, text_col: str, marker: str, name_group: int = 1, default: Column | None = None) -> DataFrame:
    """Sections of texts that hold many documents: ``key, position, filename, text``.

    Each ``marker`` line starts a section and names it. A text without one is
    one section named by ``default``.
    """
    named = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), f"(?={marker})"), lambda c: F.struct(F.regexp_extract(c, marker, name_group).alias("filename"), c.alias("chunk"))
    )
    whole = default if default is not None else F.col(key).cast("string")
    marked = lambda xs: F.filter(xs, lambda x: x["filename"] != "")
    plain = lambda xs: F.transform(xs, lambda x: F.struct(whole.alias("filename"), x["chunk"].alias("text")))
    cut = lambda ms: F.transform(ms, lambda x: F.struct(x["filename"].alias("filename"), F.regexp_replace(x["chunk"], f"^{marker}", "").alias("text")))
    sections = bind(named, lambda xs: bind(marked(xs), lambda ms: F.when(F.size(ms) > 0, cut(ms)).otherwise(plain(xs))))
    return texts.select(key, F.posexplode(sections).alias("position", "__s")).select(key, "position", "__s.*")


def text_with_fallback(documents: DataFrame, extracted: DataFrame, key: str, text: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """Stored text, else the raw one with ``used_ocr``; documents with neither are rejects ``key, reason``."""
    side = extracted.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    rows = documents.join(side, F.col(key) == F.col("__k"), "left")
    chosen = F.coalesce(F.nullif(F.trim("__t"), F.lit("")), F.nullif(F.trim(raw), F.lit("")))
    out = rows.select(key, chosen.alias("text"), F.coalesce(F.trim("__t") == "", F.lit(True)).alias("used_ocr"))
    return out.filter("text IS NOT NULL"), out.filter("text IS NULL").select(key, F.lit("no readable text").alias("reason"))


def snapshots(spark: SparkSession, directory: str, schema: str = REPORT) -> DataFrame:
    """Readable reports with numeric ids, newest first; others are dropped."""
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(directory)
    return newest_readable(rows)


def newest_readable(rows: DataFrame) -> DataFrame:
    """Parsed reports with a numeric id and nothing in ``_corrupt``, newest first."""
    return rows.filter(F.col("scan_id").rlike("^[0-9]+$") & F.col("_corrupt").isNull()).drop("_corrupt").orderBy(F.desc("started_at"), F.desc("scan_id"))


def manifests(files: DataFrame, key: str, path: str, stored: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Per notice its kept file names and their count; given fields are laid over a stored manifest.

    Kept are names under ``documents/``, but for ``temp-inspection`` and
    ``metadata.json``.
    """
    kept = F.col(path).startswith("documents/") & ~F.col(path).contains("temp-inspection") & ~F.col(path).endswith("metadata.json")
    name = F.regexp_replace(path, "^documents/", "")
    out = files.groupBy(key).agg(F.array_sort(F.collect_set(F.when(kept, name))).alias("files")).withColumn("count", F.size("files"))
    if stored is None:
        return out
    side = stored.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__s_{f}") for f in fields or []))
    return out.join(side, F.col(key) == F.col("__k"), "full_outer").select(
        F.coalesce(key, "__k").alias(key), F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("count", F.lit(0)).alias("count"), *(F.col(f"__s_{f}").alias(f) for f in fields or [])
    )


def write_batch_summary(rows: DataFrame, batch: str, columns: list[str], path: str) -> None:
    """The rows of the last batch as JSON, one object a line, so that a batch of any size can be written by many tasks; an earlier summary is replaced."""
    last = rows.agg(F.max(batch).alias("__last"))
    rows.join(F.broadcast(last), F.col(batch) == F.col("__last"), "left_semi").select(batch, *columns).write.mode("overwrite").json(path)


def review_list(rows: DataFrame, reference: str, columns: list[str]) -> DataFrame:
    """Flat review rows, those without a reference dropped, by number of reference, largest first."""
    number = F.col(reference).try_cast("bigint")
    return rows.filter(F.coalesce(F.trim(reference), F.lit("")) != "").orderBy(number.desc_nulls_last(), F.col(reference)).select(reference, *columns)
