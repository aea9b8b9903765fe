"""Sharding by sampled splitters: shards of near equal bytes, gapless places in each, native functions throughout.

The key of a record is a hash of its text, so equal texts stand together. A sample in which each record counts by its
size gives quantiles of the key as boundaries; ranges that turn out overfull (a text with very many copies) are cut
again by a hash of the record's id. A range is then a small sorted run: its bytes and rows before it are known from one
row per range, so every record knows its byte offset in the whole order, and the shard is the part of all bytes that
the middle of the record falls in. Shards are within one record's size of each other's share, whatever the sample.

Laws: ``bytes`` holds. A NULL text has size 8 like an empty one, its checksum is that of no bytes. A NULL or repeated
id is a record like others; which of rows alike in text and id gets which slot is open. No rows: no shards.
Shuffled: narrow rows (id, size, checksum, key), never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.session import written

SHARDS = 24
#: Expected sampled keys a range; a range of one shard's share cut in RANGES_PER_SHARD.
SAMPLES_PER_RANGE = 64
RANGES_PER_SHARD = 8
#: Rows that one range should hold at most, so that large inputs get more ranges.
ROWS_PER_RANGE = 250_000


def _spread(*columns: str, seed: int) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)


def records(docs: DataFrame) -> DataFrame:
    """Id, size, checksum and key of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def splitters(rows: DataFrame, n_ranges: int, total: int) -> list[int]:
    """Quantile boundaries of the keys, each record weighted by its size; ``n_ranges`` - 1 numbers at most."""
    if n_ranges < 2 or not total:
        return []
    expected = F.col("size") * (n_ranges * SAMPLES_PER_RANGE / total)
    draws = F.floor(expected + _spread("doc_id", "key", seed=1)).cast("int")
    sample = rows.select("key", F.explode(F.array_repeat(F.lit(0), draws)))
    found = sample.agg(F.percentile_approx("key", [(k + 1) / n_ranges for k in range(n_ranges - 1)], 20 * n_ranges)).first()[0]
    return sorted(set(found or []))


def _range(key: Column, bounds: list[int], step: int = 32) -> Column:
    """Number of boundaries that are at most the key: first among every ``step``-th, then among those between."""
    if not bounds:
        return F.lit(0)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    coarse = below(longs(bounds[::step]))
    fine = below(F.slice(longs(bounds), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)))
    return F.greatest(coarse - 1, F.lit(0)) * step + fine


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text)."""
    rows = written(records(docs), "records")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(shards * RANGES_PER_SHARD, n // ROWS_PER_RANGE)
    ranged = rows.withColumn("range", _range(F.col("key"), splitters(rows, n_ranges, total)))
    share = max(total / n_ranges, 1.0)
    pieces = F.greatest(F.ceil(F.col("bytes") / (2 * share)), F.ceil(F.col("n") / (2.0 * ROWS_PER_RANGE)))
    # one row per range: a size fixed by n_ranges, so it may be broadcast
    overfull = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select("range", pieces.alias("pieces"))
    placed = ranged.join(F.broadcast(overfull), "range").withColumn(
        "piece", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.col("pieces"))
    ).drop("pieces")
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = cells.select(
        "range", "piece",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("cell_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_rows"),
    )
    order = Window.partitionBy("range", "piece").orderBy("key", "doc_id", "size")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = (
        placed.select("*", earlier.alias("earlier"), (F.row_number().over(order) - 1).alias("row"))
        .join(F.broadcast(offsets), ["range", "piece"])
        .withColumn("middle", (F.col("cell_bytes") + F.col("earlier")) * 2 + F.col("size"))
        .select(
            "doc_id", "size", "text_crc32",
            F.least(F.expr(f"middle * {shards} div {2 * max(total, 1)}"), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("cell_rows") + F.col("row")).alias("rank"),
        )
    )
    ordered = written(ordered, "ordered")
    first = ordered.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
    return ordered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot")
    )
