"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints
that differ in at most two bits differ in at most one bit in one of the
segments, so they share a variant of it with one bit left out. An equality
join on these variants finds every pair, and the bit count verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_side
from .components import components

SEED = 42
LANES = np.uint64(0x0101010101010101)


def fingerprint_batch(texts: list[bytes | None], width: int) -> np.ndarray:
    """A fingerprint for each text: bit set if it is in over half of the shingle hashes."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        k = min(width, len(words))
        first = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
        hashes.extend(map(digest, map(flat.__getitem__, map(slice, first, ends[k - 1 :].tolist())), repeat(SEED)))
        counts[i] = len(words) - k + 1
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    some = np.flatnonzero(counts)
    n = counts[some]
    # sums of one byte a bit overflow beyond 255 hashes, so each text is summed in blocks
    blocks = -(-n // 255)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    of_text = np.repeat(np.arange(len(some)), blocks)
    at = np.arange(len(of_text)) - np.repeat(np.concatenate(([0], np.cumsum(blocks)[:-1])), blocks)
    starts = begin[of_text] + 255 * at
    per_text = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    bits = np.zeros(len(some), np.uint64)
    for low in range(8):
        lanes = np.add.reduceat((h >> np.uint64(low)) & LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), per_text, axis=0)
        for byte in range(8):
            bits |= (2 * sums[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + low)
    out[some] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp`` (fp as a signed long) of every whole text; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.empty(batch.num_rows, np.uint64)
            for a in range(0, batch.num_rows, 500):
                part = batch.column(1).slice(a, 500).cast(pa.binary()).to_pylist()
                fp[a : a + len(part)] = fingerprint_batch(part, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def near_links(fps: DataFrame, bits: int = 2, list_bound: int = 64) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints ``fp`` within ``bits`` (1 or 2) differing bits.

    Every such pair is connected by the links. Buckets of a variant with up
    to ``list_bound`` fingerprints are joined and verified pair by pair. The
    fingerprints of larger buckets go by the exact way: all ways to leave out
    ``bits`` bits of the 64, whose equality groups hold only true neighbours,
    each linked to the least of its group; rows grow linearly with the bucket.
    """
    spread = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b"))
        .selectExpr("fp", "b", "if(b < 32, fp & 4294967295L, shiftrightunsigned(fp, 32)) AS segment")
        .selectExpr("fp", "(segment & ~shiftleft(1L, b & 31)) | shiftleft(cast(b AS bigint), 32) AS key")
    )
    sizes = materialise(
        spread.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"),
        "buckets",
    )
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    pairs = sizes.filter("n = 2").select("u", "v").filter(close)
    larger = sizes.filter("n > 2").select("key", "n")
    if larger.isEmpty():
        return pairs.distinct()
    members = materialise(spread.join(small_side(larger), "key"), "bucket-members")
    small = members.filter(F.col("n") <= list_bound)
    listed = (
        small.select("key", F.col("fp").alias("u"))
        .join(small.select("key", F.col("fp").alias("v")), "key")
        .filter("u < v")
        .filter(close)
        .select("u", "v")
    )
    found = pairs.union(listed)
    hot = members.filter(F.col("n") > list_bound).select("fp").distinct()
    if not hot.isEmpty():
        masks = [(1 << i) | (1 << j if bits == 2 else 0) for i in range(64) for j in range(i + 1, 64 if bits == 2 else i + 2)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        mask_array = F.from_json(F.lit(str(signed)), "array<bigint>")
        left_out = hot.select("fp", F.posexplode(mask_array).alias("k", "mask")).select(
            "fp", "k", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")
        )
        # with two bits left out a group has at most four fingerprints, so it is collected rather than joined to its least
        groups = left_out.groupBy("k", "rest").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
        stars = groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u != v")
        found = found.union(stars)
    return found.distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, list_bound: int = 64
) -> DataFrame:
    """``id, fp, component`` of every row; component is the least id reachable by links.

    Rows with equal fingerprints are one node. Null and empty texts share
    fingerprint 0 and so one node, linked like any other. Null ids keep a row
    and are no component's name unless all of its ids are null. Repeated rows
    stay repeated. Other columns of ``docs`` are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), bits, list_bound))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = materialise(named.join(least, "root").select("fp", "component"), "labels")
    return rows.join(labels, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group (that with the least id).

    Of repeated rows with that id one stays; rows whose id is null all stay.
    """
    found = materialise(near_duplicates(docs, id_col, text_col, **how).filter("id IS NOT NULL"), "components")
    gone = materialise(found.filter("id != component").select(F.col("id").alias("__id")).distinct(), "near-copies")
    # rows are left where they are; only those whose id comes again are moved
    kept = docs.join(small_side(gone), F.col(id_col) == F.col("__id"), "left_anti")
    again = materialise(found.filter("id = component").groupBy(F.col("id").alias("__id")).count().filter("count > 1").select("__id"), "repeated-ids")
    if again.isEmpty():
        return kept
    again = small_side(again)
    several = kept.join(again, F.col(id_col) == F.col("__id"), "left_semi")
    least = F.min_by(F.struct(*docs.columns), F.xxhash64(text_col, *docs.columns))
    one = several.groupBy(F.col(id_col).alias("__id")).agg(least.alias("__row")).select("__row.*")
    return kept.join(again, F.col(id_col) == F.col("__id"), "left_anti").unionByName(one)
