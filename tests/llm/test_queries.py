"""The queries that have SQL against it, and the pipeline on small rows."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tenderlake.llm import registered

from ..oracle import DATA, same
from .cases import odd_rows, row, table, words


@pytest.mark.parametrize("name", sorted(registered.ORACLE))
def test_sql(spark, name):
    same(spark, registered.QUERIES[name], registered.ORACLE[name])


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in registered.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in registered.QUERIES


def test_pipeline_stages_on_odd_rows(spark):
    passage = words(80, 77, 10**6)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    docs = odd_rows() + [row(100 + i, words(120, 1000 + i, 10**6)) for i in range(40)]
    docs += [row(200, f"{words(100, 201, 10**6)} {passage}"), row(201, f"{passage} {words(100, 202, 10**6)}"), row(202, f"{words(60, 203, 10**6)} {bench} {words(60, 204, 10**6)}")]
    docs += [row(300, words(120, 1000, 10**6)), row(301, words(20, 5))]
    now = table(spark, docs)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        seen[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == table(spark, []).columns
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    assert not ids["quality_rules"] & {1, 2, 3, 4, 7, 9, 301} and {100, 139, 200, 300} <= ids["quality_rules"]
    assert 300 not in ids["simhash_near_dedup"] and {100, 200, 201, 202} <= ids["simhash_near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    assert passage in texts[200] and passage not in texts[201] and len(texts[201].split()) == 100
    assert 202 not in ids["benchmark_decontamination"] and {100, 139, 200, 201} <= ids["benchmark_decontamination"]
    assert ids["packing"] == ids["benchmark_decontamination"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), DATA).count() == 0


def test_queries_run_where_workers_lack_the_package(tmp_path):
    """The session's folder and PYTHONPATH don't have the package, so Python workers can't import it."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name == "pipeline" or name.startswith("op"):
        query(spark, {DATA!r}).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""
    keep = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=keep, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("ran ") == 14, done.stderr[-3000:]
