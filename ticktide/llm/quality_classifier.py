"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: each statistic of its structure and the stated length fall into a bin, each bin is a feature of
value 1; words are hashed into BUCKETS features of value sqrt(count), scaled to length 1. Every feature has a weight and
a vector of RANK numbers; all pairs of features interact through the product of their vectors, summed in linear time as
half the difference between the squared sum and the sum of squares. The machine is fitted by minibatch steps on a
sample of at most SAMPLE labelled rows, chosen by hash (labelled rows beyond that are not used); model and sample have
a fixed bound, so the model may go to every task. Scores read whole texts.

A NULL text is an empty one, with its own bins; an empty text gets a score. A NULL stated length has a bin. Labelled
rows with a NULL label or without a document are not learned from. Of documents that share an id, and so its label, one
is learned from: the first by a hash of its text and stated length. Without labelled rows every score is 0.5. Repeated
rows score alike. Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import RangeHash, counts, slices, word_bounds

BUCKETS = 1 << 15
RANK = 8
SAMPLE = 8_000
EPOCHS = 6
BATCH = 256
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3

# Edges of the bins of each statistic.
_RATIOS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 2.0)
_COUNTS = tuple(2.0**k for k in range(0, 18))
STATISTICS = {
    "words": _COUNTS,
    "lines": _COUNTS,
    "stated_length": _COUNTS,
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 15, 20),
    "line_words": _COUNTS,
    "symbols_per_word": _RATIOS,
    "bars_per_word": _RATIOS,
    "exclamations_per_word": _RATIOS,
    "stops_per_word": _RATIOS,
    "digits_per_byte": _RATIOS,
    "capitals_per_byte": _RATIOS,
    "beyond_ascii_per_byte": _RATIOS,
    "repeats_of_last_word": _RATIOS,
    "different_words": _RATIOS,
    "repeated_lines": _RATIOS,
}
N_BINS = max(map(len, STATISTICS.values())) + 2
N_FEATURES = len(STATISTICS) * N_BINS + BUCKETS


def _set(characters: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters.encode())] = True
    return flags


_SYMBOLS, _BARS, _EXCLAMATIONS, _STOPS = _set("#*$%&<>"), _set("|"), _set("!"), _set(".?")
_DIGITS, _CAPITALS, _BEYOND = _set("0123456789"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.arange(256) >= 128


class Sparse(NamedTuple):
    """Rows of features: ``at`` has the place of each row's first feature, and the end."""

    at: np.ndarray
    feature: np.ndarray
    value: np.ndarray


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and count of the different pairs, in order of rows."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])))) if len(r) else np.zeros(0, np.int64)
    return r[first], v[first], np.diff(first, append=len(r))


def featurise(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> Sparse:
    """Features of texts; ``stated`` is the length that the table states, NaN if none."""
    n = len(offsets) - 1
    start, end, at = word_bounds(data, offsets)
    row = np.repeat(np.arange(n), np.diff(at))
    hashes = RangeHash(data)
    word = hashes.of(start, end)
    n_words, n_bytes = np.diff(at), np.diff(offsets)
    per = lambda a, b: a / np.maximum(b, 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    line_row = np.repeat(np.arange(n), np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1)
    line_end = np.sort(np.concatenate((breaks, offsets[1:])))
    full = line_end > line_start
    line_row, line = line_row[full], hashes.of(line_start[full], line_end[full])
    n_lines = np.bincount(line_row, minlength=n)
    different_lines = np.bincount(_distinct(line_row, line, n)[0], minlength=n)

    bucket = (word >> np.uint64(49)).astype(np.int64) % BUCKETS
    b_row, b_word, b_count = _distinct(row, bucket, n)
    different = np.bincount(_distinct(row, word, n)[0], minlength=n)
    stats = {
        "words": n_words, "lines": n_lines, "stated_length": stated,
        "word_length": per(np.bincount(row, end - start, n), n_words),
        "line_words": per(n_words, n_lines),
        "symbols_per_word": per(counts(_SYMBOLS[data], offsets), n_words),
        "bars_per_word": per(counts(_BARS[data], offsets), n_words),
        "exclamations_per_word": per(counts(_EXCLAMATIONS[data], offsets), n_words),
        "stops_per_word": per(counts(_STOPS[data], offsets), n_words),
        "digits_per_byte": per(counts(_DIGITS[data], offsets), n_bytes),
        "capitals_per_byte": per(counts(_CAPITALS[data], offsets), n_bytes),
        "beyond_ascii_per_byte": per(counts(_BEYOND[data], offsets), n_bytes),
        "repeats_of_last_word": per(np.bincount(row, again, n), n_words),
        "different_words": per(different, n_words),
        "repeated_lines": per(n_lines - different_lines, n_lines),
    }
    bins = np.stack([
        k * N_BINS + np.where(np.isnan(x := np.asarray(stats[name], float)), N_BINS - 1, np.digitize(x, edges))
        for k, (name, edges) in enumerate(STATISTICS.items())
    ], axis=1)
    value = np.sqrt(b_count.astype(np.float32))
    value /= np.sqrt(np.maximum(np.bincount(b_row, b_count, n), 1))[b_row].astype(np.float32)
    rows = np.concatenate((np.repeat(np.arange(n), bins.shape[1]), b_row))
    order = np.argsort(rows, kind="stable")
    features = np.concatenate((bins.ravel(), len(STATISTICS) * N_BINS + b_word))[order]
    values = np.concatenate((np.ones(bins.size, np.float32), value))[order]
    return Sparse(np.searchsorted(rows[order], np.arange(n + 1)), features.astype(np.int32), values.astype(np.float32))


class Machine:
    """Bias, weights and vectors of a factorisation machine."""

    def __init__(self, n: int = N_FEATURES, rank: int = RANK, seed: int = 1):
        self.bias = 0.0
        self.weight = np.zeros(n, np.float32)
        self.vector = np.random.default_rng(seed).normal(0, 0.02, (n, rank)).astype(np.float32)

    def logits(self, x: Sparse) -> np.ndarray:
        """One number per row; every row has at least one feature."""
        v = self.vector[x.feature] * x.value[:, None]
        first = x.at[:-1]
        summed = np.add.reduceat(v, first, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), first)
        linear = np.add.reduceat(self.weight[x.feature] * x.value, first)
        return self.bias + linear + 0.5 * (np.einsum("ij,ij->i", summed, summed) - squares)

    def fit(self, x: Sparse, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 2) -> Machine:
        """Adam on the logistic loss, minibatch by minibatch in a fixed order."""
        rng = np.random.default_rng(seed)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weight, self.vector)]
        step = 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(y))
            for first in range(0, len(y), BATCH):
                rows = shuffled[first : first + BATCH]
                lengths = x.at[rows + 1] - x.at[rows]
                at = np.concatenate(([0], np.cumsum(lengths)))
                own = np.repeat(x.at[rows] - at[:-1], lengths) + np.arange(at[-1])
                part = Sparse(at, x.feature[own], x.value[own])
                slope = ((1 / (1 + np.exp(-self.logits(part))) - y[rows]) / len(rows)).astype(np.float32)
                each = np.repeat(slope, lengths) * part.value
                v = self.vector[part.feature]
                summed = np.add.reduceat(v * part.value[:, None], at[:-1], axis=0)
                pull = each[:, None] * (np.repeat(summed, lengths, axis=0) - v * part.value[:, None])
                features, where = np.unique(part.feature, return_inverse=True)
                g_weight = np.bincount(where, each, len(features)).astype(np.float32)
                g_vector = np.stack([np.bincount(where, pull[:, k], len(features)) for k in range(pull.shape[1])], axis=1).astype(np.float32)
                step += 1
                scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, (m, s) in zip((self.weight, self.vector), (g_weight, g_vector), moments):
                    g = g + DECAY * p[features]
                    m[features] = 0.9 * m[features] + 0.1 * g
                    s[features] = 0.999 * s[features] + 0.001 * g * g
                    p[features] -= rate * scale * m[features] / (np.sqrt(s[features]) + 1e-8)
                self.bias -= rate * float(slope.sum())
        return self


def _stated(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` of the documents that have a label and may be learned from, the first by a hash of their id; one row for each id."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` narrow rows
    rows = docs.select("doc_id", "text", _stated(docs).alias("stated")).join(F.broadcast(known), "doc_id")
    first = F.min(F.struct(F.xxhash64("text", "stated").alias("digest"), "text", "stated")).alias("first")
    return rows.groupBy("doc_id", "quality").agg(first).select("doc_id", "first.text", "first.stated", "quality")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> Machine:
    """A machine fitted on a bounded sample; the features of its rows come to the driver, the texts do not."""
    schema = "doc_id long, y int, feature array<int>, value array<float>"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text")):
                x = featurise(data, offsets, _numbers(batch.column("stated"))[first:last])
                at = pa.array(x.at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64())[first:last], batch.column("quality").cast(pa.int32())[first:last],
                     pa.ListArray.from_arrays(at, pa.array(x.feature)), pa.ListArray.from_arrays(at, pa.array(x.value))],
                    ["doc_id", "y", "feature", "value"],
                )

    rows = labelled_sample(docs, labels, learn, most).mapInArrow(extract, schema).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
    machine = Machine()
    if not rows.num_rows:
        return machine
    feature = rows["feature"].combine_chunks()
    lengths = np.array([len(f) for f in feature])
    at = np.concatenate(([0], np.cumsum(lengths)))
    x = Sparse(at, feature.flatten().to_numpy(), rows["value"].combine_chunks().flatten().to_numpy())
    machine.fit(x, (rows["y"].to_numpy() > 0).astype(np.float32))
    del x, feature, rows
    pa.default_memory_pool().release_unused()  # the driver goes on to other work
    return machine


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and the chance of label 1 of every row of ``docs`` (doc_id, text, n_chars if there is one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stated = _numbers(batch.column("stated"))
            for first, last, data, offsets in slices(batch.column("text")):
                chance = 1 / (1 + np.exp(-machine.logits(featurise(data, offsets, stated[first:last])).astype(float)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64())[first:last], pa.array(chance, pa.float64())], ["doc_id", "score"]
                )

    return docs.select("doc_id", "text", _stated(docs).alias("stated")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, that score at the threshold or above."""
    at = docs.columns.index("text")
    stated = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.log(threshold / (1 - threshold))
        for batch in batches:
            lengths = np.full(batch.num_rows, np.nan) if stated is None else _numbers(batch.column(stated))
            good = np.zeros(batch.num_rows, bool)
            for first, last, data, offsets in slices(batch.column(at)):
                good[first:last] = machine.logits(featurise(data, offsets, lengths[first:last])) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
