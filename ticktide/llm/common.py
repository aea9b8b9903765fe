"""Helpers of the operators: checked broadcasts, whole texts as byte arrays, hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide import session

SPACES = " \t\n\x0b\x0c\r"
#: Most rows that a narrow side may have to be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that a task turns into arrays at once; a longer text is taken whole.
SLICE_BYTES = 256 << 10

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, a written table, with a broadcast hint if it was counted to hold at most ``rows`` rows."""
    return F.broadcast(small) if small.count() <= rows else small


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that travel to Python at once: whole texts are wide, and Spark's own number is made for narrow rows.
ROWS_AT_ONCE = 1024


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """As :func:`ticktide.session.written`, with batches of at most ROWS_AT_ONCE rows for the Python in ``df``."""
    conf = df.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, str(min(int(before), ROWS_AT_ONCE) if int(before) > 0 else ROWS_AT_ONCE))
    try:
        return session.written(df, name)
    finally:
        conf.set(ARROW_ROWS, before)


ROW = "_row"


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` beside the whole row as one struct, so that no other column of ``docs`` meets a working name."""
    return docs.select(*columns, F.struct("*").alias(ROW))


def words(text: Column) -> Column:
    """The runs of other characters than SPACES, in order; none for NULL."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of some ``limit`` bytes; NULL is empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"").cast(pa.large_binary())
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    pa.default_memory_pool().release_unused()  # what earlier batches of this worker took
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n - 1 of the multiplier or its inverse, modulo 2**64."""
    if len(_powers[inverse]) < n:
        steps = np.full(n, _INVERSE if inverse else _MULTIPLIER, np.uint64)
        steps[0] = 1
        _powers[inverse] = np.multiply.accumulate(steps)
    return _powers[inverse][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RangeHash:
    """64-bit hashes of any byte ranges of ``data`` from one running sum; equal bytes hash alike everywhere."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(len(data), False), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _power(len(self.sums), True)[start])

    def rolling(self, width: int) -> np.ndarray:
        """Of every ``width`` bytes, by their start."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:-width]) * _power(len(self.sums), True)[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words before each text."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= ~inside[1:] | ~inside[:-1]
    start = np.flatnonzero(inside & edge[:-1])
    end = np.flatnonzero(inside & edge[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])
