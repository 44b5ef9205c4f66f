"""Structured Streaming jobs: incremental ingest, de-duplication, weekly counts, progress and keyed state.

Each job takes a streaming DataFrame and paths in a folder that all
executors share. Sinks are written by ``foreachBatch`` with the batch id in
the path, so that a batch that runs again overwrites itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType  # noqa: F401

from ..functions.rules import RuleSet
from ..operators import lifecycle as L
from ..operators.classify import scan_plan
from ..sources.store import KeyedStore


def files_stream(spark: SparkSession, directory: str, schema, name: str = "*.parquet", files_per_batch: int = 8) -> DataFrame:
    """Landed Parquet files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def _run(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """ST1: the first row of each key is saved, once, whatever later batches bring; rows without a key are one key.

    Spark's state holds the first row of each key by time of batch, then by
    ``order``. A batch writes the keys that it saw first, and reads nothing
    that was written before.
    """
    names = stream.columns
    now = F.col("__now")
    first = F.min_by(F.struct(*names), F.struct(now.alias("at"), F.col(order).alias("place")))
    result = stream.withColumn("__now", F.current_timestamp()).groupBy(F.col(key).alias("__key")).agg(first.alias("__row"), F.min(now).alias("__first"), F.max(now).alias("__last"))

    def each(batch: DataFrame, epoch: int) -> None:
        batch.filter("__first = __last").select("__row.*").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return _run(result, checkpoint, "update", each)


def planned_ingest(
    stream: DataFrame, store: str, plans: str, checkpoint: str, title: str, order: str, rules: RuleSet, process: Callable[[DataFrame], DataFrame],
    survive: list[str], source: str = "scan",
) -> StreamingQuery:
    """ST1: each batch of listed rows is planned against the saved state, and what it has to process is saved.

    ``store`` is the path of a ``KeyedStore`` whose rows have ``is_manual``
    and ``reusable``; a batch reads only the buckets of its keys. A manual
    decision is reused, a clear negative title skipped, a reusable result
    reused, the rest processed; of several rows of a key in a batch the first
    by ``order`` is processed, and the others find its result. ``process``
    turns rows into rows of the store; columns in ``survive`` keep what they
    have. The plan of every row is written to ``plans``, by batch. A batch
    that runs again writes the same plans over and finds its rows saved.
    Rows without a key or a title are planned like any other, but rows
    without a key can't be saved.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        saved_rows = KeyedStore(spark, store)
        if saved_rows.has_applied(source, epoch):
            return
        key = saved_rows.key
        listed = batch.persist()
        planned = scan_plan(listed, saved_rows.rows_like(listed).select(key, "is_manual", "reusable"), key, title, rules)
        nth = F.row_number().over(Window.partitionBy(key, "plan").orderBy(order))
        again = (F.col("plan") == "process") & (F.col("__nth") > 1)
        planned = planned.withColumn("__nth", nth).withColumn("plan", F.when(again, "reuse").otherwise(F.col("plan"))).drop("__nth")
        planned.write.mode("overwrite").parquet(f"{plans}/epoch={epoch}")
        todo = spark.read.schema(planned.schema).parquet(f"{plans}/epoch={epoch}").filter("plan = 'process'")
        saved_rows.upsert(process(todo), lambda current, incoming: L.upsert(current, incoming, key, survive), source, epoch)
        listed.unpersist()

    return _run(stream, checkpoint, "append", each)


def saved(spark: SparkSession, path: str) -> DataFrame:
    """All that the batches of a job have saved."""
    return spark.read.option("basePath", path).parquet(path).drop("epoch")


def deduplicated(stream: DataFrame, at: str, delay: str, *key: str) -> DataFrame:
    """ST2: a row of each key within the watermark; state is kept for ``delay`` only."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def weekly_counts(stream: DataFrame, at: str, delay: str, offset: str = "3 days 16 hours") -> DataFrame:
    """ST3: rows per Monday-based local week; ``offset`` is Monday 00:00 at UTC+8, after the epoch."""
    w = F.window(at, "7 days", startTime=offset)
    return stream.withWatermark(at, delay).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def weekly_groups(stream: DataFrame, at: str, delay: str, identity: str, kind: Column, offset: str = "3 days 16 hours") -> DataFrame:
    """ST3, A6: per closed local week the notices that are new, saved and unknown: ``start, new, saved, unknown``.

    Two stateful operators in a chain: the rows of an identity in a week
    become one group with its best ``kind`` (0 new, 1 saved, 2 unknown) when
    the week closes, and the groups are counted. A week closes ``delay``
    after its end; rows that are later are dropped. Append mode.
    """
    known = stream.withWatermark(at, delay).filter(F.col(identity).isNotNull())
    groups = known.groupBy(F.window(at, "7 days", startTime=offset).alias("w"), F.col(identity).alias("identity")).agg(F.min(kind).alias("kind"))
    weeks = groups.groupBy(F.window(F.window_time("w"), "7 days", startTime=offset).alias("week"))
    counts = [F.count_if(F.col("kind") == i).alias(n) for i, n in enumerate(("new", "saved", "unknown"))]
    return weeks.agg(*counts).select(F.col("week.start").alias("start"), "new", "saved", "unknown")


def appended(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that each batch of an append-mode result adds."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return _run(result, checkpoint, "append", each)


class Progress(StreamingQueryListener):
    """ST4: the counters of batches, as they finish, without an aggregate of their own.

    ``totals`` adds up the metrics that ``observed`` attaches to a stream; a
    batch that runs again counts once. ``history`` has the totals after each batch.
    """

    def __init__(self, name: str) -> None:
        self.name, self.totals, self.history, self._seen = name, {}, [], set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        mark = (str(event.progress.id), event.progress.batchId)
        if row is None or mark in self._seen:
            return
        self._seen.add(mark)
        for k, v in row.asDict().items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)
        self.history.append(dict(self.totals))

    def onQueryTerminated(self, event) -> None:
        pass


    def follow(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Waits for a query to end and for the counters of all its batches that read rows, which arrive by themselves."""
        query.awaitTermination()
        batches = {p.batchId for p in query.recentProgress if p.numInputRows > 0 and self.name in p.observedMetrics}
        until = time.time() + seconds
        while time.time() < until and not batches <= {b for _, b in self._seen}:
            time.sleep(0.05)


@contextmanager
def progress(spark: SparkSession, name: str) -> Iterator[Progress]:
    """ST4: a ``Progress`` that listens while the block runs."""
    listener = Progress(name)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def observed(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """ST4: the stream as it is, counting its rows (``n``) and those of each condition on their way; ``Progress`` receives them."""
    return stream.observe(name, F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def running_counts(stream: DataFrame, scan: Column, **counts: Column) -> DataFrame:
    """ST4: counters of each scan so far."""
    return stream.groupBy(scan.alias("scan")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def keep_last(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each complete result over the one before the last; the last one stands."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/slot={epoch % 2}")

    return _run(result, checkpoint, "complete", each)


def last(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete result; at most two are kept."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.agg(F.max("epoch")).first()[0]
    return rows.filter(F.col("epoch") == newest).drop("epoch", "slot")


def decision_state(stream: DataFrame, path: str, checkpoint: str, key: str, value: str, at: str, order: str) -> StreamingQuery:
    """ST5: the last valid decision of each key, held in Spark's state; a batch writes the keys that it changed."""
    valid = stream.select(key, L.normal_decision(F.col(value)).alias("decision"), at, order).filter("decision IS NOT NULL")
    place = F.struct(at, order)
    result = valid.groupBy(key).agg(F.max_by("decision", place).alias("decision"), F.max(place).alias("__place")).select(key, "decision", "__place.*")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return _run(result, checkpoint, "update", each)


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The latest row of each key that the batches of a job have written."""
    rows = spark.read.option("basePath", path).parquet(path)
    names = [c for c in rows.columns if c not in (key, "epoch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "epoch").alias("__row")).select(key, "__row.*")


#: The setting of the state store, which jobs leave as it is.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

#: What the commands of a notice leave: its last valid decision, its last known work status, its first read and first review.
LIFECYCLE = "decision string, decided_at timestamp, decided_seq bigint, work_status string, status_at timestamp, status_seq bigint, first_read timestamp, first_review timestamp"


def lifecycle_commands(rows: DataFrame, key: str, op: str, value: str, at: str, seq: str) -> DataFrame:
    """Commands in one form: ``key, op, value, at, seq``; decisions and statuses spelled as M1 and M3 have them, unknown ones left out.

    A decision by a person is a review too, as in M1 and M4.
    """
    said = F.when(F.col(op) == "decide", L.normal_decision(F.col(value))).when(F.col(op) == "work_status", L.work_status(F.col(value), F.lit(None).cast("string"))).when(F.col(op).isin("read", "review"), F.lit(""))
    return rows.select(F.col(key).alias("key"), F.col(op).alias("op"), said.alias("value"), F.col(at).cast("timestamp").alias("at"), F.col(seq).cast("bigint").alias("seq")).filter("key IS NOT NULL AND value IS NOT NULL AND at IS NOT NULL")


def lifecycle_batch(commands: DataFrame) -> DataFrame:
    """M1, M3, M4 and M5 over all commands at once: ``key`` and ``LIFECYCLE``. The measure of ``lifecycle_state``."""
    place = F.struct("at", "seq")
    last = lambda op: F.max(F.when(F.col("op") == op, F.struct(place.alias("place"), F.col("value"))))
    found = commands.groupBy("key").agg(
        last("decide").alias("d"), last("work_status").alias("w"), F.min(F.when(F.col("op") == "read", F.col("at"))).alias("first_read"),
        F.min(F.when(F.col("op").isin("review", "decide"), F.col("at"))).alias("first_review"),
    )
    return found.select("key", F.col("d.value").alias("decision"), F.col("d.place.at").alias("decided_at"), F.col("d.place.seq").alias("decided_seq"), F.col("w.value").alias("work_status"), F.col("w.place.at").alias("status_at"), F.col("w.place.seq").alias("status_seq"), "first_read", "first_review")


def merged_lifecycle(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``LIFECYCLE`` by key, of which both sides may know a part: the later decision and status, the earlier read and review."""
    place = lambda at, seq: F.struct(at, seq)
    both = current.unionByName(incoming)
    latest = lambda c, at, seq: [F.max_by(x, F.when(F.col(c).isNotNull(), place(at, seq))).alias(x) for x in (c, at, seq)]
    return both.groupBy("key").agg(*latest("decision", "decided_at", "decided_seq"), *latest("work_status", "status_at", "status_seq"), F.min("first_read").alias("first_read"), F.min("first_review").alias("first_review"))


def lifecycle_state(commands: DataFrame, store: str, checkpoint: str, delay: str = "1 day", idle_days: float = 90) -> StreamingQuery:
    """ST5: decision, work status, first read and first review of each notice, kept as commands arrive.

    ``commands`` is a stream of ``lifecycle_commands``. A batch is folded to
    a row a notice by ``lifecycle_batch``, map side first, and these rows are
    merged into the ``KeyedStore`` at ``store``, which is the state: nothing
    is held in memory between batches, and late and out-of-order commands
    come out as in ``lifecycle_batch``. So no state needs to be cleared:
    ``delay`` and ``idle_days``, which bounded it, change nothing.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        KeyedStore(batch.sparkSession, store).upsert(lifecycle_batch(batch), merged_lifecycle, "commands", epoch)

    return _run(commands, checkpoint, "append", each)
