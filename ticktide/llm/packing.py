"""Best-fit packing: minimum bin slack over counts of piece lengths.

Each task turns texts into token ids, cuts only texts longer than a sequence and numbers its pieces of each length.
Pieces of one length are alike for packing, so all that packing needs is a count per length: at most ``room`` numbers,
whatever the input. A bin takes the longest length left; a subset-sum dynamic programme over the lengths left, one
bitset per length, finds the fullest way to fill the rest, and bins of that content are made until one of its lengths
runs out. The search is repeated with a little slack allowed, which spares short pieces, and the fewest bins are kept.
A piece's place then follows from its number within its length: counts before its task are added up per
length, and the bins of a length are ranges of numbers. No group is sorted or gathered.

Token ids come from the public byte-level vocabulary, see ``tokens``.

A NULL or empty text is the end token alone. Repeated rows are packed each. No rows: no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm.common import slices
from ticktide.llm.tokens import TEXT_BYTES, tokens
from ticktide.session import written

ROOM = 1024
END_ID = 2
#: Room that a bin may leave though it could be filled further; all are tried, the fewest bins count.
SLACKS = (0, 1, 2, 4, 8, 12, 16, 24, 32)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def pieces(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), with their task and their number among its pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = tokens(vocabulary), TaskContext.get().partitionId(), [0] * (room + 1)
        for batch in batches:
            docs_ids = batch.column(0).to_pylist()
            for first, _, data, offsets in slices(batch.column(1), TEXT_BYTES):
                ids, at = encoder.of(data, offsets)
                rows = []
                for k in range(len(offsets) - 1):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    n = -(-len(own) // room)
                    start = 0
                    for piece in range(n):
                        length = len(own) - (n - 1) * room if piece == 0 else room
                        crc = zlib.crc32(own[start : start + length].tobytes())
                        rows.append((docs_ids[first + k], piece, start, length, crc, task, seen[length]))
                        seen[length] += 1
                        start += length
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> list[int]:
    """Lengths, each no more often than ``counts`` has it, that fill ``room`` to within ``slack`` or as far as can be.

    Long ones are tried first and the search ends at the first length that makes such a sum possible, so short
    pieces are spared where long ones do.
    """
    inside, goal = (1 << (room + 1)) - 1, max(room - slack, 0)
    reach, steps = 1, []
    for length in sorted((n for n in counts if counts[n] and n <= room), reverse=True):
        # multiples in powers of two, so a length's count costs its logarithm
        left, times = min(counts[length], room // length), 1
        while left and not reach >> goal:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & inside
            left -= times
            times *= 2
        if reach >> goal:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            chosen += [length] * times
    return sorted(chosen, reverse=True)


def _bins(counts: dict[int, int], room: int, slack: int) -> list[tuple[list[int], int]]:
    left = {length: n for length, n in counts.items() if n}
    made = []
    while left:
        seed = max(left)
        left[seed] -= 1
        content = [seed, *fullest(left, room - seed, slack)]
        left[seed] += 1
        need = {length: content.count(length) for length in content}
        times = min(left[length] // n for length, n in need.items())
        made.append((content, times))
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return made


def bins(counts: dict[int, int], room: int, slacks: tuple[int, ...] = SLACKS) -> list[tuple[list[int], int]]:
    """Contents of bins and how many bins have each, until all pieces are in bins: the fewest over all ``slacks``."""
    return min((_bins(counts, room, slack) for slack in slacks), key=lambda made: sum(times for _, times in made))


class Places:
    """For each length, the ranges of piece numbers that bins of one content take."""

    def __init__(self, made: list[tuple[list[int], int]]):
        ranges: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for content, times in made:
            offsets = np.concatenate(([0], np.cumsum(content)))
            for length in dict.fromkeys(content):
                own = [int(o) for o, c in zip(offsets, content) if c == length]
                start = taken.get(length, 0)
                ranges.setdefault(length, []).append((start, first, len(own), own))
                taken[length] = start + times * len(own)
            first += times
        self.ranges = {
            length: (np.array([r[0] for r in rs]), np.array([r[1] for r in rs]), np.array([r[2] for r in rs]),
                     np.concatenate([r[3] for r in rs]), np.cumsum([0] + [r[2] for r in rs]))
            for length, rs in ranges.items()
        }

    def of(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for s, e in zip(bounds[:-1], bounds[1:]):
            rows = order[s:e]
            starts, firsts, each, offsets, at = self.ranges[int(lengths[rows[0]])]
            r = np.searchsorted(starts, numbers[rows], "right") - 1
            within = numbers[rows] - starts[r]
            sequence[rows] = firsts[r] + within // each[r]
            offset[rows] = offsets[at[r] + within % each[r]]
        return sequence, offset


def pack(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """Sequence and offset of every piece of ``cut``, a written table of ``pieces``."""
    per_task = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # at most ``room`` rows reach the driver
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(bins(counts, room))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and their offset in it."""
    return pack(written(pieces(docs, vocabulary, room, end_id), "pieces"), room)
