"""Session settings that the library expects; a cluster's own settings win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "tenderlake", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    for key, value in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; where it is unset, a folder under /tmp
    in local mode and an error elsewhere.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(scan: DataFrame) -> DataFrame:
    """``scan``, dealt over the cores if fewer of its partitions than there are cores hold rows.

    A file of one row group is cut into many splits, of which one has all the
    rows. So partitions with rows are counted, which reads the footers only.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    filled = scan.select(F.spark_partition_id().alias("part")).distinct().count()
    return scan.repartition(cores) if filled < cores else scan


#: Tables of long texts, whose rows cost much more than reading them.
LONG_TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``; long texts are ``dealt``."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(found) if name in LONG_TEXTS else found
