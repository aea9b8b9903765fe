"""The incremental news feed: poll, keep what is new, append.

What has been seen is either the sink itself, so it is never forgotten and a batch that is run
again after a failure adds nothing; or a keyed state of the stream, of which a batch reads its
own links only, with the file sink's log of batches to keep a batch from being added twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticktide.sources.files import append_news

BROADCAST_ROWS = 100_000


def lookback(items: DataFrame, now: Column, ts: str = "ts", hours: int = 24) -> DataFrame:
    """Items of the last ``hours`` before ``now``."""
    return items.filter(F.col(ts) >= now - F.expr(f"interval {hours} hours"))


def first_per_link(items: DataFrame, order: Sequence[str], link: str = "Link") -> DataFrame:
    """One row per link across all symbols, the first in ``order``; copies drop out before the shuffle."""
    w = Window.partitionBy(link).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def seen_link_filter(items: DataFrame, stored: DataFrame, order: Sequence[str], link: str = "Link") -> DataFrame:
    """First row per link that ``stored`` does not hold yet."""
    return first_per_link(items, order, link).join(stored.select(link).distinct(), link, "left_anti")


def stream_dedup(items: DataFrame, link: str = "Link", ts: str = "ts", keep: str = "24 hours") -> DataFrame:
    """Each link once within ``keep`` of event time; later arrivals than that are dropped."""
    return items.withWatermark(ts, keep).dropDuplicatesWithinWatermark([link])


def append_unseen(batch: DataFrame, sink: str, order: Sequence[str], link: str = "Link") -> None:
    """Append the batch's unseen links. Only the sink's links are read, against the batch's links.

    A small batch (its rows are counted) is broadcast to that scan; a large one is joined by shuffle.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        rows = batch.count()
        if rows == 0:
            return
        new = first_per_link(batch, order, link)
        try:
            stored = spark.read.parquet(sink).select(link)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None  # nothing stored yet
        if stored is not None:
            links = batch.select(link).distinct()
            seen = stored.join(F.broadcast(links) if rows <= BROADCAST_ROWS else links, link, "left_semi").distinct()
            new = new.join(seen, link, "left_anti")
        append_news(new, sink)
    finally:
        batch.unpersist()


def news_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    sink: str,
    checkpoint: str,
    order: Sequence[str] = ("symbol_rank", "ts"),
    now: Callable[[DataFrame], Column] | None = None,
    file_format: str = "parquet",
    every: str | None = "15 minutes",
) -> StreamingQuery:
    """Start polling ``folder``; ``every=None`` takes all there is and stops.

    ``now`` limits each batch to the 24 hours before the time it returns.
    """
    items = spark.readStream.schema(schema).format(file_format).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        append_unseen(batch if now is None else lookback(batch, now(batch)), sink, order)

    writer = items.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_ever(items: DataFrame, order: Sequence[str], link: str = "Link") -> DataFrame:
    """The first row, in ``order``, of the batch in which a link of the stream ``items`` comes for the first time.

    The state is one flag a link and never expires. Rows of a link are taken in chunks, whatever their number.
    """

    def first(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            own = frame if best is None else pd.concat([best, frame])
            best = own.sort_values(list(order), kind="stable").head(1)
        if best is not None and not state.exists:
            state.update((True,))
            yield best

    return items.groupBy(link).applyInPandasWithState(first, items.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def news_stream_with_state(
    spark: SparkSession,
    folder: str,
    schema: str,
    sink: str,
    checkpoint: str,
    order: Sequence[str] = ("symbol_rank", "ts"),
    stored: DataFrame | None = None,
    link: str = "Link",
    file_format: str = "parquet",
    every: str | None = "15 minutes",
) -> StreamingQuery:
    """As :func:`news_stream`, with the links seen so far in the stream's own keyed state, on disk beside its checkpoint.

    ``stored`` holds links from before the stream's first start. Read ``sink`` with Spark: its log of batches
    leaves out files of a batch that was broken off.
    """
    items = spark.readStream.schema(schema).format(file_format).load(folder)
    if stored is not None:
        items = items.join(stored.select(link).distinct(), link, "left_anti")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        writer = first_ever(items, order, link).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        writer = writer.outputMode("append")
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
