"""News and prices into a labelled panel with one row per symbol and day.

Grain and skew: article-level steps (deduplicating, pooling, joining labels to articles)
never window over a symbol, because one symbol can own a third of all news. Windows over
a symbol appear only on tables with one row per symbol and day, whose partitions are
bounded by the trading calendar (some 250 rows a year).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.vectors import mean_vector

PRICE_COLUMNS = ("Open", "Prev_Close", "High", "Low", "Close", "Volume")
BAR_COLUMNS = ("Open", "High", "Low", "Close", "Volume")


# ---- prices -------------------------------------------------------------------------

def plain_symbols(prices: DataFrame) -> DataFrame:
    """Rename ``Ticker`` to ``Stock`` and strip ``.BK``, only where a ``Ticker`` exists."""
    if "Ticker" not in prices.columns:
        return prices
    return prices.withColumnRenamed("Ticker", "Stock").withColumn(
        "Stock", F.replace(F.col("Stock"), F.lit(".BK"), F.lit(""))
    )


def wide_to_long(wide: DataFrame, date: str = "Date", separator: str = "|") -> DataFrame:
    """Columns ``attribute|ticker`` to one row per day and ticker; no shuffle."""
    tickers = sorted({c.split(separator, 1)[1] for c in wide.columns if separator in c})
    have = set(wide.columns)

    def bar(ticker: str) -> Column:
        cells = [
            (F.col(f"`{a}{separator}{ticker}`") if f"{a}{separator}{ticker}" in have else F.lit(None))
            .cast("double").alias(a)
            for a in BAR_COLUMNS
        ]
        return F.struct(F.lit(ticker).alias("Ticker"), *cells)

    long = wide.select(date, F.inline(F.array(*[bar(t) for t in tickers])))
    return long.filter(F.coalesce(*BAR_COLUMNS).isNotNull())


def _number(c: str) -> Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def label_open_direction(prices: DataFrame, stock: str = "Stock", date: str = "Date") -> DataFrame:
    """``Target_Label`` = 1 when a day opens above the close before it; first days drop out."""
    w = Window.partitionBy(stock).orderBy(date)
    return (
        prices.withColumn("Prev_Close", F.lag(_number("Close")).over(w))
        .filter(F.col("Prev_Close").isNotNull())
        .withColumn("Target_Label", F.coalesce((_number("Open") > F.col("Prev_Close")).cast("int"), F.lit(0)))
        .select(stock, date, "Open", "Close", "High", "Low", "Volume", "Prev_Close", "Target_Label")
    )


def union_symbols(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack per-symbol price frames, then label all of them in one windowed pass."""
    stacked = frames[0]
    for other in frames[1:]:
        stacked = stacked.unionByName(other)
    labelled = label_open_direction(stacked)
    return labelled.dropna().select(
        "Stock", F.col("Date").alias("Target_Date"), "Open", "Prev_Close", "Target_Label"
    )


# ---- news ---------------------------------------------------------------------------

def dedup_news(news: DataFrame, stock: str = "Stock", title: str = "Title", order: str = "news_id") -> DataFrame:
    """Keep the first row (smallest unique ``order``) per symbol and title.

    Only (symbol, 32-byte digest, order) is shuffled to find the survivors, and copies
    collapse before the shuffle; the rows themselves are joined on the unique ``order``.
    """
    first = news.groupBy(stock, F.unhex(F.sha2(title, 256)).alias("_digest")).agg(F.min(order).alias(order))
    return news.join(first.select(order), order, "left_semi")


def sort_news(news: DataFrame, stock: str = "Stock", date: str = "Date", tie: str = "news_id") -> DataFrame:
    return news.orderBy(F.asc(stock), F.desc(date), F.asc(tie))


def sort_panel(panel: DataFrame, stock: str = "Stock", date: str = "Target_Date") -> DataFrame:
    return panel.orderBy(stock, date)


def target_date(date: Column, shift_days: int = 1) -> Column:
    """Calendar days, not trading days: Friday's news aims at Saturday and finds no price."""
    return F.date_add(F.to_date(date), shift_days)


def shift_target_date(news: DataFrame, shift_days: int = 1) -> DataFrame:
    return news.withColumn("Target_Date", target_date(F.col("Date"), shift_days))


def latest_n_per_symbol(
    feed: DataFrame, n: int, order: Sequence[Column], stock: str = "Stock", rank: str = "item_rank"
) -> DataFrame:
    """First ``n`` items per symbol; each task sends at most ``n`` rows per symbol on."""
    w = Window.partitionBy(stock).orderBy(*order)
    return feed.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def head_tail(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    head = df.orderBy(*[F.asc(c) for c in order]).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def mean_pool(news: DataFrame, keys: Sequence[str] = ("Stock", "Target_Date"), vec: str = "vec") -> DataFrame:
    """Element-wise mean vector per key, partially aggregated before the one shuffle."""
    return news.groupBy(*keys).agg(mean_vector(F.col(vec)).alias(vec), F.count(vec).alias("n_news"))


# ---- joins --------------------------------------------------------------------------

def join_news_prices(pooled: DataFrame, labelled: DataFrame, stock: str = "Stock") -> DataFrame:
    """Both sides hold one row per symbol and day, so no key is hot."""
    return pooled.join(labelled.withColumnRenamed("Date", "Target_Date"), [stock, "Target_Date"])


def join_spread(large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, salts: int = 16) -> DataFrame:
    """Inner join of many rows per key to one narrow row per key, each key spread over ``salts`` tasks."""
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def join_hot_keys(
    large: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 64, share: float = 0.001
) -> DataFrame:
    """As :func:`join_spread` for wide ``small`` rows: only keys owning more than ``share`` of ``large`` are spread.

    There are fewer than 1 / ``share`` such keys whatever the data, so their list may be broadcast.
    """
    total = large.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = large.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.broadcast(counts.filter(F.col("_rows") > total * share).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0))))
    left = large.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = small.join(hot, key, "left").withColumn("_salt", copies).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def join_articles_labels(news: DataFrame, labelled: DataFrame, order: str = "news_id", salts: int = 16) -> DataFrame:
    labels = labelled.select("Stock", F.col("Date").alias("Target_Date"), "Target_Label")
    return join_spread(news, labels, ["Stock", "Target_Date"], F.col(order), salts)


# ---- counts -------------------------------------------------------------------------

def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rows_per_stock(df: DataFrame, minimum: int = 60, stock: str = "Stock") -> DataFrame:
    return value_counts(df, stock).withColumn("enough", F.col("n") >= minimum)


def enough_rows(df: DataFrame, minimum: int = 60, stock: str = "Stock") -> DataFrame:
    """Rows of the symbols that pass the gate."""
    passed = rows_per_stock(df, minimum, stock).filter("enough").select(stock)
    return df.join(passed, stock, "left_semi")


# ---- time order ---------------------------------------------------------------------

def part_size(n: Column, ratio: float) -> Column:
    """``int(n * ratio)`` in double arithmetic (decimals would round 90 * 0.70 differently)."""
    return F.floor(n.cast("double") * F.lit(ratio).cast("double")).cast("int")


def chrono_split(
    panel: DataFrame,
    stock: str = "Stock",
    date: str = "Target_Date",
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
) -> DataFrame:
    """Add ``rn`` (1-based), ``n_rows`` and ``split``, each symbol cut by date order."""
    w = Window.partitionBy(stock)
    n_train, n_val = part_size(F.col("n_rows"), train_ratio), part_size(F.col("n_rows"), val_ratio)
    return (
        panel.withColumn("rn", F.row_number().over(w.orderBy(date)))
        .withColumn("n_rows", F.count(F.lit(1)).over(w).cast("int"))
        .withColumn(
            "split",
            F.when(F.col("rn") <= n_train, "train")
            .when(F.col("rn") <= n_train + n_val, "val")
            .otherwise("test"),
        )
    )


def sliding_sequences(
    panel: DataFrame,
    features: str = "features",
    label: str = "Target_Label",
    window: int = 1,
    stock: str = "Stock",
    date: str = "Target_Date",
    train_ratio: float = 0.70,
    val_ratio: float = 0.15,
    min_train: int = 10,
    min_test: int = 5,
) -> DataFrame:
    """``sequence`` = the ``window`` rows before a day, ``label`` = that day's.

    Days without a full window drop out; the train part loses one row, as the first
    sequence sits one row late; symbols with too few sequences drop out.
    """
    by_date = Window.partitionBy(stock).orderBy(date)
    whole = Window.partitionBy(stock)
    n_train = F.greatest(part_size(F.col("n_rows"), train_ratio) - 1, F.lit(1))
    n_val = part_size(F.col("n_rows"), val_ratio)
    return (
        panel.select(
            stock,
            date,
            label,
            F.row_number().over(by_date).alias("rn"),
            F.count(F.lit(1)).over(whole).cast("int").alias("n_rows"),
            F.collect_list(features).over(by_date.rowsBetween(-window, -1)).alias("sequence"),
        )
        .filter(F.col("rn") > window)
        .withColumn("seq_no", F.col("rn") - window)
        .withColumn(
            "split",
            F.when(F.col("seq_no") <= n_train, "train")
            .when(F.col("seq_no") <= n_train + n_val, "val")
            .otherwise("test"),
        )
        .withColumn("_train", F.count(F.when(F.col("split") == "train", 1)).over(whole))
        .withColumn("_test", F.count(F.when(F.col("split") == "test", 1)).over(whole))
        .filter((F.col("_train") >= min_train) & (F.col("_test") >= min_test))
        .drop("_train", "_test", "rn", "n_rows")
    )


def train_cutoff(news: DataFrame, date: str = "Target_Date", ratio: float = 0.70) -> DataFrame:
    """One row: the distinct date at place ``int(n * ratio)``, counted from 0.

    The distinct dates are bounded by the calendar, so they fit one sorted array.
    """
    dates = news.select(date).distinct().agg(F.array_sort(F.collect_list(date)).alias("d"))
    return dates.select(F.get(F.col("d"), part_size(F.size("d"), ratio)).alias("cutoff"))


def global_train_split(news: DataFrame, date: str = "Target_Date", ratio: float = 0.70) -> DataFrame:
    """``is_train`` = date up to and including the cutoff."""
    cutoff = train_cutoff(news, date, ratio).scalar()
    return news.withColumn("is_train", F.col(date) <= cutoff)
