"""WARC archives: a writer that stores equal payloads once, and a splittable reader of record-wise gzip files.

A reading task has a range of bytes. It looks for the gzip magic there, takes a candidate as a record if it decodes to a WARC
header, and owns every record that starts in its range, wherever it ends; so ranges need no index and no record is read twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, slices, small

GZIP = b"\x1f\x8b\x08"
RANGE = 4_000_000
#: Ranges that a task reads one after the other.
RANGES_A_TASK = 2
STEP = 1 << 20
#: A header that has not ended after so many bytes is no WARC header.
MOST_HEADER = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_REVISITS = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a WARC/1.1 record: a response, or a revisit of the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
        "WARC-Target-URI": "".join((url or "urn:none").split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _payload() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page of a larger id has as well."""
    keyed = cut(pages.select("page_id", _payload().alias("digest")), "warc-digests")
    twins = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return keyed.join(twins, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str) -> None:
    """One archive per partition of pages: page_id, url, html. Null html is an empty payload. Rows with a null page_id, and all that share the largest page_id of a payload, are responses. Rows may share a page_id: each is a record with its own payload."""
    kind = pages.schema["page_id"].dataType.simpleString()
    again = cut(revisits(pages), "warc-revisits")
    rows = pages.select("page_id", "url", "html", _payload().alias("digest")).join(small(again, MAX_REVISITS), ["page_id", "digest"], "left")
    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(folder)
        path = f"{name}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, n, f = f"{path}.{uuid.uuid4().hex}.tmp", 0, None
        for batch, html in slices(batches, "html"):
            f = f or fs.open_output_stream(own, compression=None)
            for page, url, text, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, batch.column(3).to_pylist(), strict=True):
                f.write(record(page, url, text.as_buffer().to_pybytes(), refers))
                n += 1
        if f:
            f.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "n"])

    out = rows.select(F.col("page_id").cast(kind), "url", "html", "refers_to").mapInArrow(on, "path string, n long")
    cut(out, "warc-files")


class Source:
    """Bytes of a file from a place on, read in steps."""

    def __init__(self, file: pa.NativeFile, size: int, at: int):
        self.file, self.size, self.base, self.data = file, size, at, b""

    def take(self, at: int, n: int) -> bytes:
        while self.base + len(self.data) < min(self.size, at + n):
            self.data += self.file.read_at(min(STEP, self.size - self.base - len(self.data)), self.base + len(self.data))
        return self.data[at - self.base : at - self.base + n]

    def forget(self, at: int) -> None:
        if at - self.base > 4 * STEP:
            self.data, self.base = self.data[at - self.base :], at


def member(source: Source, at: int) -> tuple[bytes, int] | None:
    """The decoded member at a place and where it ends; None if what is there is no gzip member with a WARC header."""
    z, out, size, here = zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            part = source.take(here, 1 << 15)
            if not part:
                return None
            got = z.decompress(part)
            here += len(part) - len(z.unused_data)
            out.append(got)
            size += len(got)
            start = out[0] if len(out[0]) >= 8 else b"".join(out)
            if size >= 8 and not start.startswith(b"WARC/1."):
                return None
            if size > MOST_HEADER and len(out) > 1 and b"\r\n\r\n" not in b"".join(out)[:MOST_HEADER]:
                return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, here) if data.startswith(b"WARC/1.") else None


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line for k, _, v in [line.partition(":")]}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    inner, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(inner), payload


def records(path: str, start: int, stop: int, size: int) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """The records of a file that start in [start, stop): offset, WARC fields, HTTP fields, payload."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        source, at = Source(f, size, start), start
        while at < stop:
            window = source.take(at, STEP + len(GZIP) - 1)
            found = window.find(GZIP)
            if found < 0:
                at += max(1, len(window) - len(GZIP) + 1)
                source.forget(at)
                continue
            at += found
            if at >= stop:
                return
            got = member(source, at)
            if got is None:
                at += 1
                continue
            yield at, *parse(got[0])
            at = got[1]
            source.forget(at)


def _page(field: str | None) -> int | None:
    text = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, folder: str, payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """A row per record of all archives of a folder: page_id, url, record_type, refers_to, payload_bytes, payload_digest, file, place, and with payload the payload.

    Length and digest are of the full payload: measured on a response, and then held against its header (ValueError if they differ), taken from the headers of a revisit.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).where("length > 0").select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("size"))
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"), "size")
    plan = ranges.repartition(max(1, ranges.count() // RANGES_A_TASK))

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for at, warc, http, data in records(path, start, stop, size):
                    kind, stated = warc.get("warc-type"), warc.get("warc-payload-digest", "").removeprefix("sha1:")
                    length, hashed = (int(http.get("content-length", 0)), stated) if kind == "revisit" else (len(data), digest(data))
                    if stated and stated != hashed:
                        raise ValueError(f"{path} at {at}: the payload does not match its digest")
                    rows.append((_page(warc.get("warc-record-id")), warc.get("warc-target-uri"), kind, _page(warc.get("warc-refers-to")), length, hashed, path, at, data if payload else None))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return plan.mapInArrow(on, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, place long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "place", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def through_archives(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write pages to archives in shared storage and read them back. An empty table gives an empty result."""
    folder = shared_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder, payload)
