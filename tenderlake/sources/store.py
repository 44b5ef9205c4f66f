"""A table of rows by key in a shared folder, with versions.

Rows lie in buckets by a hash of their key. A batch writes new files for the
buckets that it touches and then a manifest, which names the files of every
bucket; readers see the newest manifest, so they see all of a batch or
nothing. A manifest also names the last batch of each source, so a batch that
runs again is recognised. One job at a time writes a table; a second one
finds its version taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lifecycle import keep_first_append

#: The folder name of a bucket's files.
BUCKET = "store_bucket"
#: A bucket that consists of more folders is written anew as one.
MOST_FOLDERS = 8

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedStore:
    """The table at ``path``. ``read`` gives its rows; ``upsert`` and ``append_first`` write a version.

    Keys are unique in the table. Rows without a key aren't stored.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        numbers = self._versions()
        if not numbers:
            raise FileNotFoundError(f"no table at {path}")
        self.state = self._manifest(numbers[-1])
        self.schema = StructType.fromJson(self.state["schema"])
        self.key: str = self.state["key"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64) -> KeyedStore:
        """An empty table. A bucket is rewritten by one task, so choose ``buckets`` for about 128 MB each at the size to come."""
        if BUCKET in schema.names or key not in schema.names:
            raise ValueError(f"columns: {schema.names}")
        state = {"version": 0, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "files": {}, "applied": {}}
        _put(spark, f"{path.rstrip('/')}/versions/{0:012d}", json.dumps(state))
        return cls(spark, path)

    @property
    def version(self) -> int:
        return self.state["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest version or an earlier one that is kept."""
        state = self.state if version is None else self._manifest(version)
        return self._rows([f for folders in state["files"].values() for f in folders])

    def has_applied(self, source: str, batch: int) -> bool:
        """Whether this or a later batch of a source is in the table."""
        return self.state["applied"].get(source, -1) >= batch

    def rows_like(self, incoming: DataFrame) -> DataFrame:
        """The rows of the buckets that the keys of ``incoming`` fall in."""
        return self._rows([f for b in self._touched(incoming) for f in self.state["files"].get(b, [])])

    def upsert(self, incoming: DataFrame, merge: Merge, source: str, batch: int, order: str | None = None) -> bool:
        """Merges a batch by key; false if it had been applied before.

        ``merge(current, incoming)`` gets the rows of the touched buckets and
        returns what replaces them. Of incoming rows with one key the last by
        ``order`` counts; without an order their keys must be unique.
        """
        if self.has_applied(source, batch):
            return False
        rows = incoming.filter(F.col(self.key).isNotNull())
        if order:
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), order).alias("__row")).select(self.key, "__row.*")
        touched = self._touched(rows)
        current = self._rows([f for b in touched for f in self.state["files"].get(b, [])])
        written = self._write(merge(current, rows))
        files = {b: f for b, f in self.state["files"].items() if b not in touched} | {b: [f] for b, f in written.items()}
        self._commit(files, source, batch)
        return True

    def append_first(self, incoming: DataFrame, order: str, source: str, batch: int) -> DataFrame:
        """Adds the first row, by ``order``, of each key that isn't in the table; nothing stored is changed.

        Returns the incoming rows with their ``outcome``, saved or exists; a
        batch that runs again gets the outcomes of its first run.
        """
        outcomes = f"{self.path}/outcomes/{source}-{batch}"
        if not self.has_applied(source, batch):
            rows = incoming.filter(F.col(self.key).isNotNull())
            keep_first_append(self.rows_like(rows).select(self.key), rows, self.key, order).write.mode("overwrite").parquet(outcomes)
            written = self._write(self.spark.read.parquet(outcomes).filter("outcome = 'saved'"))
            files = {b: list(f) for b, f in self.state["files"].items()}
            for b, f in written.items():
                files.setdefault(b, []).append(f)
            full = {b: f for b, f in files.items() if len(f) > MOST_FOLDERS}
            if full:
                files.update({b: [f] for b, f in self._write(self._rows([x for f in full.values() for x in f])).items()})
            self._commit(files, source, batch)
        return self.spark.read.parquet(outcomes)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` manifests and the files that these don't name, those of failed batches too; how many folders went."""
        numbers = self._versions()
        used = {f.split("/")[1] for n in numbers[-keep:] for folders in self._manifest(n)["files"].values() for f in folders}
        fs, root = _fs(self.spark, f"{self.path}/data")
        gone = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName() not in used]
        for n in numbers[:-keep]:
            _fs(self.spark, self.path)[0].delete(_path(self.spark, f"{self.path}/versions/{n:012d}"), False)
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def _versions(self) -> list[int]:
        fs, root = _fs(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict:
        return json.loads(_get(self.spark, f"{self.path}/versions/{version:012d}"))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.state["buckets"]))

    def _touched(self, incoming: DataFrame) -> list[str]:
        """Names of buckets, at most as many as the table has."""
        return [str(r[0]) for r in incoming.filter(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect()]

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows as new folders; their names by bucket."""
        name = f"data/{uuid.uuid4().hex}"
        ready = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), self._bucket().alias(BUCKET))
        ready.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        fs, root = _fs(self.spark, f"{self.path}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        return {n.split("=")[1]: f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def _commit(self, files: dict[str, list[str]], source: str, batch: int) -> None:
        state = self.state | {"version": self.version + 1, "files": files, "applied": self.state["applied"] | {source: batch}}
        _put(self.spark, f"{self.path}/versions/{state['version']:012d}", json.dumps(state))
        self.state = state


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path; any store that Spark reads will do."""
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a new file whole: under another name first, then renamed. Fails if it is there already."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(f"another job has written {path}")
    draft = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(draft, p):
        fs.delete(draft, False)
        raise FileExistsError(f"another job has written {path}")
