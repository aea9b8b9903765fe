"""WARC bundles: records in independent Zstandard frames, a seek table at the end, an index of record ids.

Each task writes bundles of its own into the shared folder: records gather in a frame until it holds FRAME_BYTES, each
frame can be decompressed by itself, and a skippable frame at the end lists the sizes of all frames (the public
seekable format). The index, a table, maps a record id to file, frame and offset in the frame, so one record costs one
frame to read. A bundle's name is new in each attempt and only attempts that succeed enter the index, so a task that
is run again leaves no wrong entry.

Of records with equal payloads of at least ``least`` bytes the one with the largest page id is a response and the
others revisit it; a revisit keeps its headers only. Rows that share that largest id are all responses. A NULL html is
an empty payload; a NULL id counts as smaller than any other and refers like others; if a payload has NULL ids only,
they are responses. No rows: no bundles. Only digests are shuffled unless the copies' table is too large to broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm.common import checked
from ticktide.session import scratch, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20  # compressed
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_type string, file string, frame int, offset long, length long"
RECORDS = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    end = data.index(b"\r\n\r\n", at)
    return dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:]), end + 4


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one begins. A response's digest is computed anew."""
    head, start = _headers(data, at)
    end = start + int(head[b"Content-Length"])
    http, body = _headers(data, start)
    revisit = head[b"WARC-Type"] == b"revisit"
    payload = data[body:end]
    said = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if not revisit and (digest(payload) != said or len(payload) != int(http[b"Content-Length"])):
        raise ValueError(f"payload of {head[b'WARC-Record-ID'].decode()} doesn't match its digest")
    number = lambda urn: None if urn is None or b"null" in urn else int(re.search(rb"-?\d+", urn)[0])
    return {
        "page_id": number(head[b"WARC-Record-ID"]),
        "record_type": "revisit" if revisit else "response",
        "refers_to": number(head.get(b"WARC-Refers-To")),
        "url": urllib.parse.unquote(head[b"WARC-Target-URI"].decode()) if b"WARC-Target-URI" in head else None,
        "payload_bytes": int(http[b"Content-Length"]),
        "payload_digest": said,
        "payload": None if revisit else payload,
    }, end + 4


class Bundle:
    """A file of frames under way."""

    def __init__(self, folder: str):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.size = io.BytesIO(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of a record."""
        if self.buffer.tell() and self.buffer.tell() + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.buffer.tell()
        self.buffer.write(data)
        return at

    def flush(self) -> None:
        if self.buffer.tell():
            raw = self.buffer.getvalue()
            self.out.write(packed := self.zstd.compress(raw))
            self.frames.append((len(packed), len(raw)))
            self.size += len(packed)
            self.buffer = io.BytesIO()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, folder: str, name: str):
        system, path = fs.FileSystem.from_uri(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.at, start = [], 0
        for packed, raw in sizes:
            self.at.append((start, packed, raw))
            start += packed

    def frame(self, k: int) -> bytes:
        start, packed, raw = self.at[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, start), max_output_size=raw)

    def record(self, frame: int, offset: int) -> dict:
        return parse(self.frame(frame), offset)[0]


def write_bundles(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the index, a written table."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    copies = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id"))
        .filter("n > 1 and response_id is not null").select("sha1", "response_id")
    )
    rows = rows.join(checked(written(copies, "copies")), "sha1", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            index = []
            for x in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "response_id"))):
                page_id, url, payload, sha1, response_id = (v.as_py() for v in x)
                revisit = response_id is not None and (page_id is None or page_id < response_id)
                said = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(page_id, url, payload, said, response_id, revisit)
                bundle = bundle or Bundle(folder)
                frame, offset = bundle.add(data)
                index.append((page_id, "revisit" if revisit else "response", bundle.name, frame, offset, len(data)))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*index) if index else [[]] * 6, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["page_id", "record_type", "file", "frame", "offset", "length"],
            )
        if bundle:
            bundle.close()

    return written(rows.mapInArrow(write, INDEX), "index")


_FIELDS = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def read_bundles(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that ``index`` names, read frame by frame."""
    files = written(index.groupBy("file").agg(F.count("*").alias("n")), "files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                bundle = Reader(folder, name)
                for k in range(len(bundle.at)):
                    data, at, found = bundle.frame(k), 0, []
                    while at < len(data):
                        got, at = parse(data, at)
                        found.append(got if with_payload else got | {"payload": None})
                    yield pa.RecordBatch.from_pylist(found, schema=_FIELDS)

    return files.repartition(max(1, files.count()), "file").mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to bundles in the shared folder and read them back, without payloads."""
    folder = scratch(spark, "warc")
    return read_bundles(write_bundles(pages, folder, least), folder, with_payload=False)
