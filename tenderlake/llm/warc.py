"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable
frame at the end lists the sizes of all frames. A record is found by its
bundle, its frame and its offset in the frame. Records with a payload that
an earlier page has are written as revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Bytes of records in a frame and of frames in a bundle, before they are closed.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: str | None, digest: str, url: str | None = None) -> str:
    """The same for the same page and payload; a page without an id goes by its address."""
    name = f"page:{key}:{digest}" if key is not None else f"address:{url}:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def build_record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit without a payload where ``refers_to`` names another page."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest, url)),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if key is not None:
        fields.append(("WARC-Page-ID", key))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``offset``."""
    split = data.index(b"\r\n\r\n", offset)
    lines = data[offset:split].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    begin = split + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


class BundleWriter:
    """Frames and their sizes; ``add`` gives the frame and the offset in it, ``close`` the bytes of the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.done, self.sizes, self.open = frame_bytes, bytearray(), [], bytearray()
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        at = len(self.sizes), len(self.open)
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._end_frame()
        return at

    def _end_frame(self) -> None:
        frame = self.compressor.compress(bytes(self.open))
        self.sizes.append((len(frame), len(self.open)))
        self.done += frame
        self.open = bytearray()

    def close(self) -> bytes:
        if self.open:
            self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return bytes(self.done) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """``start, compressed size, size`` of each frame, from the end of the bundle."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    sizes = list(struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]))
    starts = [0]
    for c, _ in sizes:
        starts.append(starts[-1] + c)
    return [(s, c, d) for s, (c, d) in zip(starts, sizes, strict=False)]


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    start, compressed, size = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + compressed], max_output_size=size)


def record_at(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, from its frame alone."""
    return parse_record(read_frame(bundle, seek_table(bundle)[frame]), offset)[:2]


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` with ``first``: the least id with the same payload of at least ``min_bytes``, where the page isn't that itself."""
    sums = F.sha1(_payload(F.col("html"))).alias("sha"), F.octet_length(_payload(F.col("html"))).alias("n")
    small = materialise(pages.filter("page IS NOT NULL").select("page", *sums), "payload-digests")
    # written before they are joined: adaptive execution can then split the pages of a payload that many share
    firsts = materialise(
        small.filter(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("page").alias("first"), F.count("*").alias("copies")), "first-pages"
    )
    later = small.join(firsts.filter("copies > 1").drop("copies"), ["sha", "n"]).filter("page > first").select("page", "first", "sha").distinct()
    named = pages.filter("page IS NOT NULL").withColumn("sha", sums[0]).join(later, ["page", "sha"], "left")
    unnamed = pages.filter("page IS NULL").select("*", *sums).join(firsts, ["sha", "n"], "left")
    return named.drop("sha").unionByName(unnamed.drop("sha", "n", "copies"))


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> tuple[str, DataFrame]:
    """Writes all pages; returns the path of the bundles and the index ``record, page, bundle, frame, offset``.

    The path is a Parquet table ``bundle, data`` of whole bundles, so that
    any store that Spark writes will do and a task that is run again leaves
    no second copy; ``export_bundle`` gives one as a file. Null html is an
    empty payload. Repeated ids with equal payloads are written each, as
    what the first of them is, and share a record identifier. A page without
    an id is a revisit of any page with its payload. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page"].dataType.simpleString()
    to_write = with_first(rows, min_bytes).select(F.col("page").cast("string").alias("page"), "url", _payload(F.col("html")).alias("payload"), F.col("first").cast("string").alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed() -> pd.DataFrame:
            data = writer.close()
            return pd.DataFrame({"bundle": [hashlib.sha1(data).hexdigest()], "data": [data], "records": [[r for r, _, _, _ in places]], "pages": [[p for _, p, _, _ in places]], "frames": [[f for _, _, f, _ in places]], "offsets": [[o for _, _, _, o in places]]})

        writer, places = BundleWriter(frame_bytes), []
        for rows in frames:
            for page, url, payload, first in rows.itertuples(index=False):
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                places.append((record_id(page, digest, url), page, *writer.add(build_record(page, url, payload, digest, first))))
                if len(writer.done) >= bundle_bytes:
                    yield closed()
                    writer, places = BundleWriter(frame_bytes), []
        if places:
            yield closed()

    path = new_path(spark, "warc")
    schema = "bundle string, data binary, records array<string>, pages array<string>, frames array<int>, offsets array<long>"
    to_write.mapInPandas(run, schema).write.parquet(path)
    index = (
        spark.read.parquet(path)
        .select("bundle", F.explode(F.arrays_zip("records", "pages", "frames", "offsets")).alias("x"))
        .select(F.col("x.records").alias("record"), F.col("x.pages").cast(kind).alias("page"), "bundle", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset"))
    )
    return path, index


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``page, record_type, payload_bytes, payload_digest, refers_to, bundle, frame, offset, payload_ok``.

    Length and digest of a response are those of the payload that was read;
    ``payload_ok`` says whether its headers state the same. Revisits have
    theirs from the headers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for bundle, data in rows.itertuples(index=False):
                out = []
                for n, frame in enumerate(seek_table(data)):
                    records, at = read_frame(data, frame), 0
                    while at < len(records):
                        headers, block, end = parse_record(records, at)
                        payload, kind = block[block.index(b"\r\n\r\n") + 4 :], headers["WARC-Type"]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(headers["WARC-Payload-Length"])
                        ok = True
                        if kind != "revisit":
                            stated, length, digest = (length, digest), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            ok = stated == (length, digest)
                        out.append((headers.get("WARC-Page-ID"), kind, length, digest, headers.get("WARC-Refers-To-Page-ID"), bundle, n, at, ok))
                        at = end
                yield pd.DataFrame(out, columns=["page", "record_type", "payload_bytes", "payload_digest", "refers_to", "bundle", "frame", "offset", "payload_ok"])

    schema = "page string, record_type string, payload_bytes long, payload_digest string, refers_to string, bundle string, frame int, offset long, payload_ok boolean"
    return spark.read.parquet(path).select("bundle", "data").mapInPandas(run, schema)


def read_by_index(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """Every record, or those of ``pages(page)``, by its entry in the index: ``record, page, record_type, payload_bytes, payload_digest, refers_to``.

    The frame of an entry is found by the seek table of its bundle, and only
    frames that hold wanted records are decompressed. A record at another
    place than its entry says is an error. Pages without an id are only read
    where all records are. Repeated rows have an entry and a record each.
    """
    stored = spark.read.parquet(path)
    if pages is not None:
        # the wanted places meet their bundle by its name; bundles without any aren't read
        places = stored.select("bundle", F.explode(F.arrays_zip("records", "pages", "frames", "offsets")).alias("x")).select("bundle", "x.*")
        wanted = places.join(pages.select(F.col("page").cast("string").alias("pages")).distinct(), "pages", "left_semi")
        lists = [F.collect_list(c).alias(c) for c in ("records", "pages", "frames", "offsets")]  # a bundle's records are bounded by its size
        stored = stored.select("bundle", "data").join(wanted.groupBy("bundle").agg(*lists), "bundle")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for data, records, pages, places, offsets in rows.itertuples(index=False):
                table, out, held = seek_table(data), [], (-1, b"")
                for n, at, record, page in sorted(zip(places, offsets, records, pages, strict=True), key=lambda x: x[:2]):
                    if held[0] != n:
                        held = n, read_frame(data, table[n])
                    headers, block, _ = parse_record(held[1], at)
                    if headers["WARC-Record-ID"] != record:
                        raise ValueError(f"another record than {record} at {n}, {at}")
                    payload, kind = block[block.index(b"\r\n\r\n") + 4 :], headers["WARC-Type"]
                    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
                    if kind != "revisit":
                        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    out.append((record, page, kind, length, digest, headers.get("WARC-Refers-To-Page-ID")))
                yield pd.DataFrame(out, columns=["record", "page", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    schema = "record string, page string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    return stored.select("data", "records", "pages", "frames", "offsets").mapInPandas(run, schema)


def export_bundle(spark: SparkSession, path: str, bundle: str, to: str) -> None:
    """One bundle as a file on the driver's machine."""
    row = spark.read.parquet(path).filter(F.col("bundle") == bundle).select("data").first()
    with open(to, "wb") as f:
        f.write(row["data"])
