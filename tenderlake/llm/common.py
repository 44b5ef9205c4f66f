"""What the operators share: materialised steps, word splitting, process caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt as spread  # noqa: F401

#: Fixed values. White space that separates words, and the ASCII capitals that are lower-cased.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Folders of sessions that have none, by application; for tests and single machines.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        found = _OWN_DIRS[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def process_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, across tasks."""
    home = sys.modules.setdefault("tenderlake_process_cache", types.ModuleType("tenderlake_process_cache"))
    if name not in home.__dict__:
        home.__dict__[name] = make()
    return home.__dict__[name]


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Keys that may be broadcast (about 50 MB of them); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def small_side(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys as the side of a join: broadcast if it has at most ``most`` rows, by a count of them."""
    return F.broadcast(keys) if keys.count() <= most else keys
