"""Token files: ids of whole texts as Parquet lists in order of doc_id, laid out for selective reads.

Documents are dealt into ranges of (doc_id, hash of the text, place in the input), sorted within each range, and only
then turned into ids, so texts travel once and files hold ascending ids. A part knows its number and counts the ids
before each of its documents as it writes; the small table of parts says how many ids all earlier parts hold, and the
two add up to a document's start in the whole stream.

Layout: ids are lists of 32-bit numbers, by dictionary (two bytes an id before compression) or by delta; doc_id, at and
n_tokens are delta-encoded beside them, and metadata columns stand in a struct of their own. Row groups and pages have
set sizes, and every column chunk has page indexes. So lengths and metadata are read without the ids, and a range of
doc_id reads the pages that hold it.

Texts are whole; NULL is empty, and an empty text is the end token alone. Rows of a NULL doc_id come first. Rows of one
doc_id are ordered by the hash of their texts; rows alike are interchangeable and may fill any number of parts.
Other columns are only stored if named in ``keep``, whatever their names. No rows: files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.llm.common import checked, slices
from ticktide.llm.tokens import TEXT_BYTES, tokens
from ticktide.operators.ordered import running_totals

END_ID = 2
GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 256
ENCODINGS = ("dictionary", "delta")
#: Parts whose totals are added up together.
PARTS_TOGETHER = 1024


def layout(encoding: str = "dictionary", group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Options of the Parquet writer."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {ENCODINGS}")
    ordered = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "at", "n_tokens")}
    return ordered | {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # whole numbers without a dictionary are delta-encoded
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID, keep: Sequence[str] = ()) -> DataFrame:
    """part, at, doc_id, n_tokens, ids and meta (if ``keep`` names columns) of every row, in ascending order."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*keep).alias("meta")] if keep else [])]
    order = ["doc_id", "tie", "place"]
    rows = docs.select(*columns, F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "place")
    schema = T._parse_datatype_string("part int, at long, doc_id long, n_tokens long, ids array<int>")
    if keep:
        schema.add("meta", rows.schema["meta"].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = tokens(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), TEXT_BYTES):
                own, before = encoder.of(data, offsets)
                counts = np.diff(before) + 1
                ends = np.cumsum(counts)
                ids = np.empty(int(ends[-1]), np.int32)
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside], ids[~inside] = own, end_id
                cells = [
                    pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), batch.column(0).slice(first, last - first),
                    pa.array(counts), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)),
                    *(batch.column(k).slice(first, last - first) for k in range(2, batch.num_columns)),
                ]
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(cells, schema.names)

    return rows.mapInArrow(encode, schema)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, keep: Sequence[str] = (), options: dict[str, str] | None = None
) -> None:
    """Write ``path``/tokens and then ``path``/parts (part, n_tokens, start); ``options`` as made by :func:`layout`."""
    encoded(docs, vocabulary, end_id, keep).write.options(**(options or layout())).parquet(f"{path}/tokens")
    files = docs.sparkSession.read.parquet(f"{path}/tokens")
    per_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    part = F.col("part").cast("long")
    before = running_totals(per_part, [], "part", ["n_tokens"], (F.floor(part / PARTS_TOGETHER), part))
    before.select("part", "n_tokens", F.col("n_tokens_before").cast("long").alias("start")).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids and meta of documents ``first`` to ``last``; columns that are not used are not read."""
    files = spark.read.parquet(f"{path}/tokens")
    if first is not None:
        files = files.filter(F.col("doc_id") >= first)
    if last is not None:
        files = files.filter(F.col("doc_id") <= last)
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start"))
    others = [c for c in files.columns if c not in ("part", "at", "doc_id")]
    return files.join(checked(parts), "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), *others)


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit numbers, from what ``read_tokens`` gives."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = np.fromiter((zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, len(lists))
            cells = [batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
