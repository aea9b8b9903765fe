"""Queries: the incremental feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.plans.oracle import with_views
from ticktide.plans.registry import query
from ticktide.session import scratch
from ticktide.sources import files as IO
from ticktide.sources.tables import Tables
from ticktide.streaming import news as N

ORDER = ("symbol_rank", "ts", "item_id")
SCHEMA = "item_id bigint, symbol_rank int, Stock string, ts timestamp_ntz, Link string, Title string, event_type string, value double"
# three deliveries: the first 10 days, the next 10, the rest
PARTS = ("2024-01-01", "2024-01-11", "2024-01-21", "2100-01-01")
PART_SQL = "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"
FIRST = f"SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY Link ORDER BY {PART_SQL}, symbol_rank, ts, item_id) = 1"


def deliveries(t: Tables) -> list[DataFrame]:
    feed = t.feed()
    return [feed.filter((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))) for a, b in zip(PARTS, PARTS[1:])]


def polled(t: Tables, again: bool = False, stream=N.news_stream) -> DataFrame:
    """Deliver the feed in three parts; after each, a restarted stream takes what is there."""
    inbox, sink, state = (scratch(t.spark, n) for n in ("inbox", "stored", "state"))
    for part in deliveries(t):
        part.write.mode("append").parquet(inbox)
        if again:
            part.write.mode("append").parquet(inbox)
        stream(t.spark, inbox, SCHEMA, sink, state, ORDER, every=None).awaitTermination()
    return t.spark.read.parquet(sink)


@query("j7_seen_link_filter", with_views("feed", """SELECT item_id, Stock, Link FROM (SELECT * FROM feed WHERE ts >= TIMESTAMP '2024-01-21') QUALIFY
  row_number() OVER (PARTITION BY Link ORDER BY symbol_rank, ts, item_id) = 1 AND Link NOT IN (SELECT Link FROM feed WHERE ts < TIMESTAMP '2024-01-21')"""))
def seen_link_filter(t: Tables) -> DataFrame:
    a, b, new = deliveries(t)
    return N.seen_link_filter(new, a.unionByName(b), ORDER).select("item_id", "Stock", "Link")


@query("s6_append_news", with_views("feed", "SELECT Stock, count(*) AS n FROM (" + FIRST + ") GROUP BY Stock"))
def append_news(t: Tables) -> DataFrame:
    sink = scratch(t.spark, "stored")
    for part in deliveries(t):
        N.append_unseen(part, sink, ORDER)
        N.append_unseen(part, sink, ORDER)
    return t.spark.read.parquet(sink).groupBy("Stock").agg(F.count("*").alias("n"))


@query("x1_news_stream", with_views("feed", "SELECT item_id, Stock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, Link, Title FROM (" + FIRST + ")"))
def news_stream(t: Tables) -> DataFrame:
    return polled(t).select("item_id", "Stock", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "Link", "Title")


@query("x2_stream_dedup", with_views("feed", "SELECT item_id, Stock, Link FROM (" + FIRST + ")"))
def stream_dedup(t: Tables) -> DataFrame:
    """Every delivery comes twice; each link is stored once."""
    return polled(t, again=True).select("item_id", "Stock", "Link")


@query("x1_news_stream_with_state", with_views("feed", "SELECT item_id, Stock, Link FROM (" + FIRST + ")"))
def news_stream_with_state(t: Tables) -> DataFrame:
    """The links seen so far in keyed state; every delivery comes twice."""
    return polled(t, again=True, stream=N.news_stream_with_state).select("item_id", "Stock", "Link")


@query("x2_dedup_within_a_day", with_views("feed", "SELECT Link, CAST(1 AS BIGINT) AS n FROM feed GROUP BY Link"))
def dedup_within_a_day(t: Tables) -> DataFrame:
    """Links carry their hour, so copies lie within the watermark and a single pass drops them all."""
    inbox, sink, state = (scratch(t.spark, n) for n in ("inbox", "stored", "state"))
    t.feed().withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(inbox)
    items = t.spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).parquet(inbox)
    kept = N.stream_dedup(items).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
    kept.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink).groupBy("Link").agg(F.count("*").alias("n"))


@query("x3_lookback_24h", with_views("feed", "SELECT item_id, Stock, Link FROM feed WHERE ts >= (SELECT max(ts) FROM feed) - INTERVAL 24 HOUR"))
def lookback_24h(t: Tables) -> DataFrame:
    newest = t.feed().agg(F.max("ts").alias("m")).scalar()
    return N.lookback(t.feed(), newest).select("item_id", "Stock", "Link")
