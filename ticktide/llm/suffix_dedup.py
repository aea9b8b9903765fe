"""Repeated byte strings across all texts: which strings of WIDTH bytes start at two or more places, exactly.

What a suffix array of all bytes would tell by common prefixes of WIDTH or more is found on a sample of suffixes, as
induced sorting does on its sampled positions, by naming and recursion, with Spark's external shuffles in the place
of disk-backed queues; ranks and common prefixes of single bytes are never stored (README: why, with figures).

Sample: of the hashes of every SEED bytes within a string of WIDTH bytes the smallest, first of equals, is the string's
anchor. It depends on the string alone, so equal strings have it at the same place. Neighbouring starts with one anchor
form a run, some WIDTH / 2 starts long; a run's name is a 128-bit digest of all its bytes.
Naming: a name that comes twice is repeated whole. Names that come once, but share their anchor's seed with others, are
taken apart: into pieces of LEVELS starts, aligned at the anchor, each with a digest of all its bytes and one of the
bytes common to all its strings. Equal digests: repeated whole. No common core with another: not repeated at all. What
is left goes to the next level, down to single starts. Each level sees only what the one before left open: borders of
repeated passages. Levels are grouped counts over digests, so no group of equal strings is gathered anywhere.
Induction: what is repeated goes back to all texts that hold the run, as spans.

Texts are whole and matched as UTF-8 bytes; matches never cross texts. A NULL text is empty. Texts shorter than WIDTH
lose nothing. Repeated rows are other places, so all of a text of WIDTH bytes or more goes if the text comes twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import BROADCAST_ROWS, ROW, RangeHash, boxed, checked, slices
from ticktide.session import written

WIDTH = 400
SEED = 32
LEVELS = (64, 8, 1)
#: Starts handled at once; a longer text is taken in overlapping parts.
PART = 4 << 20

_PLACE = np.uint64((1 << 24) - 1)


def _lowest(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours."""
    n = len(key)
    rows = -(-n // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def find_runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """First and last start, anchor and the anchor's seed hash of every run."""
    if len(data) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if len(data) - width + 1 > PART and len(offsets) == 2:
        parts = []
        for first in range(0, len(data) - width + 1, PART):
            part = data[first : first + PART + width - 1]
            lo, hi, anchor, name = find_runs(part, np.array([0, len(part)]), width, seed)
            parts.append((lo + first, hi + first, anchor + first, name))
        return tuple(np.concatenate(x) for x in zip(*parts))
    rolled = RangeHash(data).rolling(seed)
    # the place in the low bits makes the first of equals the lowest, and tells where it is
    low = _lowest((rolled & ~_PLACE) | np.arange(len(rolled), dtype=np.uint64), width - seed + 1)
    inside = np.zeros(len(low) + 1, np.int32)
    long_ = np.diff(offsets) >= width
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - width + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(start):
        return find_runs(data[:0], offsets[:1], width, seed)
    anchor = (low[start] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(cut[1:], len(start)) - 1
    return start[cut], start[last], anchor[cut], rolled[anchor[cut]]


def _batch(names: list[str], cells: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cells], names)


def _names(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of byte ranges, as two 64-bit numbers each."""
    digest = hashlib.blake2b
    packed = b"".join([digest(data[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist())])
    return np.frombuffer(packed, np.int64).reshape(-1, 2)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two numbers that name the row: id and hash of the text. Rows alike in both are alike in text."""
    return docs.withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(
        "k2", F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))
    )


TEXT, RUN = ["k1", "k2"], ["u1", "u2"]


def runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """TEXT, first start, last start, anchor, seed and name (RUN) of all runs of all rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (1, 2))
            for first, _, data, offsets in slices(batch.column(0)):
                lo, hi, anchor, seed = find_runs(data, offsets, width)
                name = _names(data.tobytes(), lo, hi + width)
                row = np.searchsorted(offsets, lo, "right") - 1
                base = offsets[row]
                longs = [k1[first + row], k2[first + row], seed.view(np.int64), name[:, 0], name[:, 1]]
                ints = [x.astype(np.int32) for x in (lo - base, hi - base, anchor - base)]
                yield _batch(["k1", "k2", "seed", "u1", "u2", "lo", "hi", "anchor"], longs + ints)

    long_ = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) >= width
    return keyed(docs).filter(long_).select("text", *TEXT).mapInArrow(
        scan, "k1 long, k2 long, seed long, u1 long, u2 long, lo int, hi int, anchor int"
    )


_PIECE = "u1 long, u2 long, k1 long, k2 long, lo int, hi int, anchor int, c1 long, c2 long, f1 long, f2 long"


def pieces(docs: DataFrame, parts: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """``parts``, a written table of RUN, TEXT, lo, hi and anchor, cut at every ``size`` starts, with digests of core and of all bytes."""
    wanted = written(parts.groupBy(*TEXT).agg(F.collect_list(F.struct(*RUN, "lo", "hi", "anchor")).alias("parts")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (1, 2))
            for row in range(batch.num_rows):
                data = batch.column(0)[row].as_py().encode()
                own = batch.column(3)[row].values
                u1, u2, lo, hi, anchor = (x.to_numpy().astype(np.int64) for x in own.flatten())
                # numbers of pieces count from the anchor backwards, so they are the same in equal strings
                near, far = (anchor - hi) // size, (anchor - lo) // size
                each = far - near + 1
                of = np.repeat(np.arange(len(lo)), each)
                number = np.repeat(near - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
                first = np.maximum(lo[of], anchor[of] - number * size - size + 1)
                last = np.minimum(hi[of], anchor[of] - number * size)
                core = anchor[of] - number * size
                c = _names(data, core, core - size + 1 + width)
                f = _names(data, first, last + width) if size > 1 else c
                n = len(of)
                longs = [u1[of], u2[of], np.full(n, k1[row]), np.full(n, k2[row])]
                ints = [x.astype(np.int32) for x in (first, last, anchor[of])]
                yield _batch([x.split()[0] for x in _PIECE.split(", ")], [*longs, *ints, c[:, 0], c[:, 1], f[:, 0], f[:, 1]])

    # a part is some 40 bytes
    side = F.broadcast(wanted) if parts.count() <= 2 * BROADCAST_ROWS else wanted
    return keyed(docs.select("doc_id", "text")).join(side, TEXT).select("text", *TEXT, "parts").mapInArrow(cut, _PIECE)


def _count_of(df: DataFrame, key: list[str], *more: Column) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("times"), *more)


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """TEXT and the list of spans (start, end) that are repeated, merged; texts without any are left out."""
    every = written(runs(docs, width), "runs")
    # one text for each name: what holds for it holds for all that have the name
    units = written(_count_of(every, RUN, *[F.first(c).alias(c) for c in (*TEXT, "lo", "hi", "anchor", "seed")]), "units")
    twice = written(units.filter("times > 1").select(*RUN), "repeated_runs")
    seeds = units.groupBy("seed").agg(F.count("*").alias("names")).filter("names > 1").select("seed")
    open_ = units.join(checked(written(seeds, "seeds")), "seed", "left_semi").select(*RUN, *TEXT, "lo", "hi", "anchor")
    firsts = open_ = written(open_, "open_runs")
    found = None
    for size in (n for n in LEVELS if 4 * n <= width):
        level = written(pieces(docs, open_, size, width), "pieces")
        cores = _count_of(level, ["c1", "c2"], F.min("f1").alias("a"), F.max("f1").alias("b")).filter("times > 1")
        cores = written(cores.select("c1", "c2", (F.col("a") != F.col("b")).alias("several")), "cores")
        level = level.join(checked(cores), ["c1", "c2"])
        whole = written(_count_of(level, ["c1", "c2", "f1", "f2"]).filter("times > 1").drop("times"), "whole")
        full = level.join(checked(whole), ["c1", "c2", "f1", "f2"], "left_semi").select(*RUN, "lo", "hi")
        full = written(full, "found")
        found = full if found is None else found.unionByName(full)
        if size > 1:
            left = level.filter("several").groupBy("c1", "c2", "f1", "f2").agg(*[F.first(c).alias(c) for c in (*RUN, *TEXT, "lo", "hi", "anchor")])
            open_ = written(left.select(*RUN, *TEXT, "lo", "hi", "anchor"), "open")
    # places within the run, for all texts that hold it
    base = firsts.select(*RUN, F.col("lo").alias("base"))
    partly = found.join(checked(base), RUN).groupBy(*RUN).agg(
        F.collect_list(F.struct((F.col("lo") - F.col("base")).alias("from"), (F.col("hi") - F.col("base")).alias("to"))).alias("parts")
    )
    partly = written(partly.join(checked(twice), RUN, "left_anti"), "partly")
    # runs that are not repeated stay in the stream up to the pass that joins neighbours, which leaves them out
    marked = every.join(checked(twice).withColumn("again", F.lit(True)), RUN, "left")
    whole_spans = marked.select(*TEXT, "lo", (F.col("hi") + width).alias("end"), "again")
    part_spans = every.join(checked(partly), RUN).select(*TEXT, "lo", F.explode("parts").alias("p")).select(
        *TEXT, (F.col("lo") + F.col("p.from")).alias("lo"), (F.col("lo") + F.col("p.to") + width).alias("end"), F.lit(True).alias("again")
    )
    spans = whole_spans.unionByName(part_spans).mapInArrow(_joined, _SPAN)
    spans = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("lo", "end")).alias("spans"))
    return spans.mapInArrow(_merged, "k1 long, k2 long, spans array<struct<lo:int,end:int>>")


_SPAN = "k1 long, k2 long, lo int, end int"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring repeated rows of one text that touch, as one span; runs of a text are stored in order."""
    for batch in batches:
        batch = batch.filter(batch.column(4).is_valid())
        k1, k2, lo, end = (batch.column(k).to_numpy() for k in range(4))
        if len(lo):
            cut = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (lo[1:] > end[:-1]) | (lo[1:] < lo[:-1]))))
            yield _batch(["k1", "k2", "lo", "end"], [k1[cut], k2[cut], lo[cut], np.maximum.reduceat(end, cut)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans in order, those that overlap or touch as one."""
    for batch in batches:
        out, sizes = [], [0]
        for own in batch.column(2):
            lo, end = (x.to_numpy() for x in own.values.flatten())
            order = np.argsort(lo, kind="stable")
            lo, top = lo[order], np.maximum.accumulate(end[order])
            cut = np.flatnonzero(np.concatenate(([True], lo[1:] > top[:-1])))
            out.append((lo[cut], top[np.append(cut[1:], len(lo)) - 1]))
            sizes.append(sizes[-1] + len(cut))
        flat = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int32) for k in (0, 1)]
        spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in flat], ["lo", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)], ["k1", "k2", "spans"])


def _rest(data: Column, spans: Column) -> Column:
    """The bytes outside ``spans``, joined through their hexadecimal form: every byte is copied a set number of times."""
    at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    till = lambda i: F.when(i == F.size(spans), F.octet_length(data)).otherwise(F.get(spans, i)["lo"])
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.hex(F.substring(data, at(i) + 1, till(i) - at(i))))
    return F.unhex(F.array_join(pieces, ""))


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """Every row as ROW, its text, ``spans`` and ``kept``."""
    found = written(repeated(docs, width), "spans")
    rows = keyed(boxed(docs, "doc_id", "text")).join(checked(found), TEXT, "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<lo:int,end:int>>"))
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = rows.select(ROW, "text", spans.alias("spans"), data.alias("data"))
    return rows.select(ROW, "text", "spans", F.when(F.size("spans") == 0, F.col("data")).otherwise(_rest(F.col("data"), F.col("spans"))).alias("kept"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` with its removed ``spans`` (from, to in bytes) and the bytes that are ``kept``.

    Columns of ``docs`` that have these two names give way to them; all others are returned as they are.
    """
    rows = _cut(docs, width)
    others = [F.col(ROW)[c].alias(c) for c in docs.columns if c.lower() not in ("spans", "kept")]
    return rows.select(*others, "spans", "kept")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the texts that are left; of a character that a cut divides, the other bytes go as well.

    All other columns are returned as they are, whatever their names.
    """
    rest = F.make_valid_utf8(F.col("kept").cast("string"))
    # the replacement character stands for cut ones, unless the text has some of its own
    rest = F.when(F.contains("text", F.lit("\ufffd")), rest).otherwise(F.translate(rest, "\ufffd", ""))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(rest)
    return _cut(docs, width).select(*[text.alias(c) if c == "text" else F.col(ROW)[c].alias(c) for c in docs.columns])
