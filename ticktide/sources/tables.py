"""News, prices, vectors and feeds derived from the given tables (see FIXTURES.md).

``Title`` is the whole document text, every document and every line item takes part.
Markets are closed at weekends: lines of a Saturday or Sunday open Monday's bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.session import written

# The symbols of the test tables, by rank.
SYMBOLS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
N_SYMBOLS = len(SYMBOLS)
BROADCAST_ROWS = 1_000_000  # of two narrow columns; more suppliers are joined by shuffle


class Tables:
    """The input tables of one scale factor; everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several branches of one query read, written to the shared folder on first use."""
        if name not in self._written:
            self._written[name] = written(make(), name)
        return self._written[name]

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """Use all cores on inputs with fewer splits than cores; large inputs are left as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

    def symbols(self) -> DataFrame:
        """One row per symbol: rank, symbol, ticker, company name."""
        return self.read("region").select(
            F.col("r_regionkey").alias("symbol_rank"),
            F.col("r_name").alias("Stock"),
            F.concat("r_name", F.lit(".BK")).alias("Ticker"),
            F.concat(F.lower("r_name"), F.lit(" public company")).alias("name"),
        )

    def lines(self) -> DataFrame:
        """Traded lines: symbol, day, unit price, quantity and a total order within the day."""
        nation = self.read("nation").select(
            F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("symbol_rank")
        )
        traded_by = (
            self.read("supplier")
            .select("s_suppkey", "s_nationkey")
            .join(nation, "s_nationkey")
            .join(self.symbols().select("symbol_rank", "Stock"), "symbol_rank")
            .select(F.col("s_suppkey").alias("l_suppkey"), "Stock")
        )
        suppliers = self.read("supplier").count()  # from the file footers
        if suppliers <= BROADCAST_ROWS:
            traded_by = F.broadcast(traded_by)
        # day, l_orderkey, l_linenumber, l_extendedprice, l_quantity packed into one number, so
        # that the first and last price of a bar aggregate in fixed-width buffers.
        sequence = F.expr(
            "cast(cast(l_orderkey * 8 + l_linenumber as decimal(19,0)) + (2 - closed) * 10000000000000000000BD as decimal(20,0)) * 1000000000000BD"
            " + cast(cast(round(l_extendedprice * 100) as bigint) * 100 + cast(l_quantity as bigint) as decimal(14,0))"
        )
        return (
            self.read("lineitem")
            .withColumn("day", F.to_date("l_shipdate"))
            .withColumn("closed", F.when(F.dayofweek("day") == 7, 2).when(F.dayofweek("day") == 1, 1).otherwise(0))
            .withColumn("Date", F.date_add("day", F.col("closed")))
            .join(traded_by, "l_suppkey")
            .select(
                "Stock",
                "Date",
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                F.col("l_quantity").alias("quantity"),
                sequence.alias("sequence"),
            )
        )

    def prices(self) -> DataFrame:
        """Daily bars, one row per symbol and trading day."""
        return self.lines().groupBy("Stock", "Date").agg(
            F.min_by("price", "sequence").alias("Open"),
            F.max("price").alias("High"),
            F.min("price").alias("Low"),
            F.max_by("price", "sequence").alias("Close"),
            F.sum("quantity").alias("Volume"),
        )

    def prices_wide(self) -> DataFrame:
        """One row per day, one column per attribute and ticker (``Open|ASIA.BK``)."""
        bars = self.prices().join(self.symbols().select("Stock", "Ticker"), "Stock")
        tickers = [f"{s}.BK" for s in SYMBOLS]
        return bars.groupBy("Date").agg(
            *[
                F.max(F.when(F.col("Ticker") == t, F.col(a))).alias(f"{a}|{t}")
                for a in ("Open", "High", "Low", "Close", "Volume")
                for t in tickers
            ]
        )

    def news(self) -> DataFrame:
        docs = self.spread(self.read("documents"), "doc_id")
        day = F.date_add(F.lit("1995-03-01").cast("date"), ((F.col("doc_id") * 37) % 250).cast("int"))
        return (
            docs.withColumn("symbol_rank", F.pmod("n_chars", F.lit(N_SYMBOLS)).cast("int"))
            .join(self.symbols().select("symbol_rank", "Stock"), "symbol_rank")
            .select(
                F.col("doc_id").alias("news_id"),
                "Stock",
                day.alias("Date"),
                F.col("text").alias("Title"),
                F.col("source").alias("Source"),
                F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("Link"),
            )
        )

    def titles(self) -> DataFrame:
        """Raw headlines with source tags, markup and links: all documents and all pages."""
        text, source = F.col("text"), F.col("source")
        raw = (
            F.when(F.col("lang") == "en", F.concat(F.lit("<b>"), text, F.lit("</b> - "), source))
            .when(F.col("lang") == "fr", F.concat(text, F.lit(" | "), source, F.lit(" - "), F.col("lang")))
            .when(F.col("lang") == "de", F.concat(F.lit("https://news.example/"), source, F.lit(" www.x.example "), text))
            .otherwise(text)
        )
        docs = self.spread(self.read("documents"), "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), raw.alias("Title"))
        pages = self.spread(self.read("pages"), "page_id").select(
            F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
            F.concat(F.col("html"), F.lit(" "), F.col("url"), F.lit(" - "), F.col("url")).alias("Title"),
        )
        return docs.unionByName(pages)

    def published(self) -> DataFrame:
        """Feed items with their publish time as RFC-822 text; errors carry text nobody can read."""
        stamp = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
        raw = F.when(F.col("event_type") == "error", F.concat(F.lit("about "), F.date_format("ts", "yyyy"))).otherwise(stamp)
        return self.read("events").select("event_id", raw.alias("published"))

    def doc_vec(self) -> DataFrame:
        """One vector per news item; every row of ``embeddings`` is used."""
        vectors = self.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
        n_vectors = vectors.agg(F.count("vec_id").alias("n")).scalar()
        return (
            self.read("documents")
            .select(F.col("doc_id").alias("news_id"), (F.col("doc_id") % n_vectors).alias("vec_id"))
            .join(vectors, "vec_id")
            .select("news_id", "vec")
        )

    def feed(self) -> DataFrame:
        """Feed items whose links repeat within and across symbols."""
        kind = F.get_json_object("props", "$.k")
        return (
            self.read("events")
            .withColumn("symbol_rank", (F.col("user_id") % N_SYMBOLS).cast("int"))
            .join(self.symbols().select("symbol_rank", "Stock"), "symbol_rank")
            .select(
                F.col("event_id").alias("item_id"),
                "symbol_rank",
                "Stock",
                "ts",
                F.concat_ws(
                    "/", "event_type", kind, F.date_format("ts", "yyyyMMddHH")
                ).alias("Link"),
                F.concat_ws(" ", F.lit("Item"), "event_type", kind).alias("Title"),
                "event_type",
                "value",
            )
        )
