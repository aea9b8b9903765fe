"""Reading and writing the library's files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.functions.vectors import columns_to_vector
from ticktide.operators import panel as P

NEWS_SCHEMA = "Stock string, Date string, Title string, Source string, Link string"
NEWS_STREAM_SCHEMA = "Stock string, Source string, Date string, Title string, Link string"
PRICE_SCHEMA = "Date date, Ticker string, Open double, High double, Low double, Close double, Volume double"
RESULT = "probability_up double, confidence double, signal int, label string"
SNAPSHOT_SCHEMA = (
    "Stock string, updated_at string, date string,"
    " news array<struct<headline:string, source:string, date:string, link:string>>,"
    " prediction struct<news_count:int, error:string,"
    " results:array<struct<model:string, probability_up:double, confidence:double, signal:int, label:string>>,"
    " recommended:struct<model:string, probability_up:double, confidence:double, signal:int, label:string>>"
)

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_news(spark: SparkSession, path: str | Sequence[str], schema: str = NEWS_SCHEMA) -> DataFrame:
    """Headline CSV, quoted titles may hold line breaks. ``Date`` stays text: it may be unreadable."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def read_prices(spark: SparkSession, path: str | Sequence[str], schema: str = PRICE_SCHEMA) -> DataFrame:
    """Price CSV; a ``Ticker`` column becomes ``Stock`` without its ``.BK``."""
    return P.plain_symbols(spark.read.schema(schema).option("header", True).csv(path))


def read_dataset(spark: SparkSession, path: str, prefix: str = "vec_", file_format: str = "csv") -> DataFrame:
    """Modelling table with its numbered columns gathered into ``vec``; sorted by symbol and day."""
    reader = spark.read.option("header", True)
    names = reader.format(file_format).load(path).columns
    types = {"Stock": "string", "Target_Date": "date", "Target_Label": "int"}
    schema = T.StructType()
    for c in names:
        schema.add(c, T._parse_datatype_string(types.get(c, "double")))
    df = reader.schema(schema).format(file_format).load(path)
    return P.sort_panel(columns_to_vector(df, prefix))


def write_dataset(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by symbol and year; the year keeps a symbol's folder from being one file's work."""
    by_year = panel.withColumn("year", F.year("Target_Date"))
    by_year.repartition("Stock", "year").write.mode(mode).partitionBy("Stock", "year").parquet(path)


def write_news_csv(news: DataFrame, path: str, mode: str = "overwrite") -> None:
    news.write.mode(mode).options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)


def append_news(news: DataFrame, path: str) -> None:
    news.write.mode("append").parquet(path)


# ---- reports ------------------------------------------------------------------------

BULKY = ("y_prob", "y_true", "importances", "all_cols")


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per symbol and model, without the per-row score lists."""
    report.drop(*BULKY).write.mode(mode).json(path)


def read_reports(
    spark: SparkSession, paths: dict[str, str], schema: str | None = None, one_array: bool = False
) -> DataFrame:
    """Reports by model name; missing or unreadable files are skipped, ``model`` comes from the key.

    ``one_array`` reads files that hold one JSON list each instead of an object per line.
    """
    found = None
    for model, path in paths.items():
        try:
            reader = spark.read.option("multiLine", one_array).option("mode", "DROPMALFORMED")
            one = (reader.schema(schema) if schema else reader).json(path)
        except AnalysisException:
            continue
        if "Stock" not in one.columns and "stock" not in one.columns:
            continue
        one = one.withColumnRenamed("stock", "Stock") if "stock" in one.columns else one
        one = one.drop("model").withColumn("model", F.lit(model)).filter(F.col("Stock").isNotNull())
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    if found is None:
        return spark.createDataFrame([], schema or "model string, Stock string, accuracy double, auc_roc double, f1_score double")
    return found


def write_snapshot(snapshot: DataFrame, path: str) -> str:
    """Write a new version below ``path`` and then the row that points to it; returns the version.

    Readers see the version before until the pointer is there, and for ever if the write breaks off. Earlier
    versions stay for readers that hold them, and for their owner to drop.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    snapshot.write.json(f"{path}/versions/{version}")
    one = snapshot.sparkSession.range(1).select(F.lit(version).alias("version"))
    one.coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole prediction snapshot; no rows when there is none or it holds nothing readable.

    ``path`` may also be a plain JSON file or folder without versions.
    """
    try:
        newest = spark.read.schema("version string").parquet(f"{path}/pointers").agg(F.max("version")).first()[0]
        path = f"{path}/versions/{newest}"
    except AnalysisException:
        pass  # no versions
    try:
        df = spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], SNAPSHOT_SCHEMA)
    return df.filter(F.col("Stock").isNotNull())


# The search address of the feed and its words around the symbol.
FEED_SEARCH = "https://news.google.com/rss/search?q="
FEED_LANGUAGE = "&hl=th&gl=TH&ceid=TH:th"
SEARCHED = ('หุ้น "', '"')


def fetch_plan(
    symbols: DataFrame, first: str = "2021-04-01", end: str = "2026-04-01", query: Column | None = None
) -> DataFrame:
    """One row per symbol and month of [first, end): window and URL-encoded search text."""
    asked = F.concat(F.lit(SEARCHED[0]), F.col("Stock"), F.lit(SEARCHED[1])) if query is None else query
    months = F.sequence(F.lit(first).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr("interval 1 month"))
    plan = symbols.select("Stock", F.replace(F.url_encode(asked), F.lit("+"), F.lit("%20")).alias("query"),
                          F.explode(months).alias("start"))
    address = F.concat(
        F.lit(FEED_SEARCH), F.col("query"), F.lit("+after:"), F.col("start").cast("string"),
        F.lit("+before:"), F.last_day("start").cast("string"), F.lit(FEED_LANGUAGE),
    )
    return plan.select("Stock", "start", F.last_day("start").alias("end"), "query", address.alias("url"))
