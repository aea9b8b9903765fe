"""Tables behind the pages: quotes, histories, the dashboard, details and the feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.display import fixed, half_even, shown_label, shown_percent

NO_PRICE = "-"
# Texts shown on the dashboard (up, down, waiting for the model, no data yet).
UP, DOWN, WAITING, NO_DATA = "ขึ้น", "ลง", "รอผลจากโมเดล", "ยังไม่มีข้อมูล"


def last_bars(prices: DataFrame, n: int, stock: str = "Stock", date: str = "Date") -> DataFrame:
    """The last ``n`` trading days per symbol; ``back`` = 1 is the newest."""
    w = Window.partitionBy(stock).orderBy(F.desc(date))
    return prices.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def latest_quote(symbols: DataFrame, prices: DataFrame) -> DataFrame:
    """Newest close, change against the one before, and how both are shown."""
    two = last_bars(prices, 2).groupBy("Stock").agg(
        F.max(F.when(F.col("back") == 1, F.col("Close"))).alias("current"),
        F.max(F.when(F.col("back") == 2, F.col("Close"))).alias("prev"),
        F.count(F.lit(1)).alias("_n"),
    )
    known = F.col("_n") == 2
    change = F.col("current") - F.col("prev")
    pct = F.when(F.col("prev") != 0, change / F.col("prev") * 100).otherwise(F.lit(0.0))
    sign = F.when(change >= 0, "+").otherwise("")
    shown = F.concat(sign, fixed(change, 2), F.lit(" ("), sign, fixed(pct, 2), F.lit("%)"))
    return symbols.select("Stock").join(two, "Stock", "left").select(
        "Stock",
        F.when(known, fixed(F.col("current"), 2)).otherwise(NO_PRICE).alias("price"),
        F.when(known, shown).otherwise(NO_PRICE).alias("change"),
        F.coalesce(F.when(known, change >= 0), F.lit(True)).alias("is_positive"),
    )


def price_history(prices: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` trading days with rounded closes, one row per day."""
    return last_bars(prices, n).select("Stock", "Date", half_even(F.col("Close"), 2).alias("close"), "back")


def history_arrays(history: DataFrame) -> DataFrame:
    """At most ``n`` (day, close) pairs per symbol, oldest first."""
    return history.groupBy("Stock").agg(
        F.array_sort(F.collect_list(F.struct(F.col("Date").alias("date"), "close"))).alias("history")
    )


def sparkline_points(history: DataFrame) -> DataFrame:
    """Closes scaled to the unit square per symbol; fewer than two points give a flat line."""
    w = Window.partitionBy("Stock")
    low, high, n = F.min("close").over(w), F.max("close").over(w), F.count(F.lit(1)).over(w)
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    i = n - F.col("back")
    return history.select(
        "Stock", "Date",
        F.when(n < 2, F.lit(0.0)).otherwise(i / F.greatest(n - 1, F.lit(1))).alias("x"),
        F.when(n < 2, F.lit(0.5)).otherwise((F.col("close") - low) / span).alias("y"),
    )


def dashboard(symbols: DataFrame, quotes: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per symbol; the model's signal, where there is one, overrides the price direction.

    ``predictions``: Stock, updated_at, signal, confidence of the recommended model.
    """
    joined = symbols.join(quotes, "Stock", "left").join(predictions, "Stock", "left")
    has = F.col("confidence").isNotNull() | F.col("signal").isNotNull()
    up = F.when(has, F.coalesce("signal", F.lit(1)) == 1).otherwise(F.col("is_positive"))
    said = F.concat(F.when(up, UP).otherwise(DOWN), F.lit(" ("), shown_percent(F.col("confidence"), 0), F.lit(")"))
    return joined.select(
        "Stock", "name", "price", "change",
        up.alias("is_positive"),
        F.when(has, said).otherwise(WAITING).alias("sentiment"),
        F.coalesce("updated_at", F.lit("-")).alias("updated_at"),
    )


def shown_result(result: Column) -> dict[str, Column]:
    """Display fields of one model result struct (signal, label, probability_up, confidence)."""
    return {
        "signal": result["signal"],
        "label": shown_label(result["label"]),
        "prob": shown_percent(result["probability_up"]),
        "confidence": shown_percent(result["confidence"]),
    }


def format_signal(results: DataFrame) -> DataFrame:
    return results.select(
        "Stock", "model", "signal",
        shown_label(F.col("label")).alias("label"),
        shown_percent(F.col("probability_up")).alias("prob"),
        shown_percent(F.col("confidence")).alias("confidence"),
        shown_percent(F.col("confidence"), 0).alias("confidence_short"),
    )


def stored_or_fresh(symbols: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored items where a symbol has any, else its fresh items."""
    without = symbols.join(stored.select("Stock").distinct(), "Stock", "left_anti").select("Stock")
    chosen = fresh.join(without, "Stock", "left_semi")
    return stored.join(symbols.select("Stock"), "Stock", "left_semi").unionByName(chosen, allowMissingColumns=True)


def stock_detail(
    symbol: str, symbols: DataFrame, quotes: DataFrame, predictions: DataFrame, recommended: DataFrame,
    stored: DataFrame, fresh: DataFrame, history: DataFrame, models: Sequence[str] = ("lstm", "rf"), n_news: int = 5,
) -> DataFrame:
    """Everything the detail page shows for one symbol (any case); no row for an unknown one.

    ``stored`` and ``fresh`` carry item_rank; stored news are shown whole, fresh ones up to ``n_news``.
    """
    one = symbols.filter(F.col("Stock") == symbol.upper())
    news = stored_or_fresh(one, stored, fresh.filter(F.col("item_rank") <= n_news))
    items = news.groupBy("Stock").agg(
        F.array_sort(F.collect_list(F.struct("item_rank", "headline", "source", "date", "link"))).alias("news")
    )
    mine = predictions.filter(F.col("Stock") == symbol.upper())
    page = one.join(quotes, "Stock", "left")
    for m in models:
        r = mine.filter(F.col("model") == m).select(
            "Stock", F.col("label").alias(f"{m}_label"), F.col("probability_up").alias(f"{m}_p"), F.col("confidence").alias(f"{m}_c"),
            F.col("signal").alias(f"{m}_signal"),
        )
        page = page.join(r, "Stock", "left")
    best = recommended.select(
        "Stock", F.col("model").alias("_model"), F.col("label").alias("_label"), F.col("confidence").alias("_conf"), "updated_at"
    )
    page = page.join(best, "Stock", "left").join(items, "Stock", "left").join(history_arrays(history), "Stock", "left")
    shown = []
    for m in models:
        shown += [
            F.col(f"{m}_signal"), shown_label(F.col(f"{m}_label")).alias(f"{m}_label"),
            shown_percent(F.col(f"{m}_p")).alias(f"{m}_prob"), shown_percent(F.col(f"{m}_c")).alias(f"{m}_confidence"),
        ]
    return page.select(
        "Stock", "name", "price", "change", "is_positive", *shown,
        F.upper(F.coalesce("_model", F.lit("-"))).alias("recommended_model"),
        shown_label(F.col("_label")).alias("recommended_label"),
        shown_percent(F.col("_conf")).alias("recommended_conf"),
        F.coalesce("updated_at", F.lit(NO_DATA)).alias("updated_at"),
        F.coalesce("news", F.array()).alias("news"),
        F.coalesce("history", F.array()).alias("history"),
    )


def merged_feed(symbols: DataFrame, stored: DataFrame, fresh: DataFrame, n_fresh: int = 3) -> DataFrame:
    """All symbols' items, newest first; items without a timestamp come last, in symbol order."""
    fed = stored_or_fresh(symbols, stored, fresh.filter(F.col("item_rank") <= n_fresh))
    ranked = fed.join(symbols.select("Stock", "symbol_rank"), "Stock")
    return ranked.orderBy(F.desc(F.coalesce("timestamp", F.lit(0.0))), "symbol_rank", "item_rank")


def filter_feed(feed: DataFrame, symbol: str = "all") -> DataFrame:
    return feed if symbol == "all" else feed.filter(F.col("Stock") == symbol)


def needs_refresh(snapshot: DataFrame, today: Column, date: str = "date") -> DataFrame:
    """One row: whether no symbol has been scored today."""
    return snapshot.agg((F.count(F.when(F.col(date) == today, 1)) == 0).alias("needs_refresh"))
