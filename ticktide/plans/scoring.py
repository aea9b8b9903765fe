"""The daily scoring job: newest news per symbol to a prediction snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions.display import threshold_signal
from ticktide.operators import metrics as M
from ticktide.operators import panel as P

Score = Callable[[DataFrame], DataFrame]


def daily_scoring_job(
    symbols: DataFrame, feed: DataFrame, vectors: DataFrame, score: Score, reports: DataFrame, today: Column,
    order: Sequence[Column], n: int = 10, threshold: float = 0.5,
) -> DataFrame:
    """One nested record per symbol from its ``n`` newest items; symbols without news get an error.

    ``feed``: Stock, news_id, headline, source, date, link and the columns of ``order``.
    ``score``: (Stock, vec, n_news) to (Stock, model, y_prob). ``reports``: model, Stock, auc_roc, model_rank.
    """
    newest = P.latest_n_per_symbol(feed, n, order)
    items = newest.groupBy("Stock").agg(  # at most n items a symbol
        F.array_sort(F.collect_list(F.struct("item_rank", "headline", "source", "date", "link"))).alias("_items")
    )
    news = F.transform("_items", lambda i: F.struct(*[i[c].alias(c) for c in ("headline", "source", "date", "link")]))
    pooled = P.mean_pool(newest.select("Stock", "news_id").join(vectors, "news_id"), ["Stock"])
    signal = threshold_signal(F.col("y_prob"), threshold)
    results = score(pooled).select("Stock", "model", *[c.alias(k) for k, c in signal.items()])
    fields = ("model", "probability_up", "confidence", "signal", "label")
    all_results = results.groupBy("Stock").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    best = M.pick_best_model(reports, results, symbols).select("Stock", F.struct(*fields).alias("recommended"))
    joined = symbols.select("Stock").join(items, "Stock", "left").join(all_results, "Stock", "left").join(best, "Stock", "left")
    has_news = F.col("_items").isNotNull()
    return joined.select(
        "Stock",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        today.cast("string").alias("date"),
        news.alias("news"),
        F.struct(
            F.when(has_news, F.size("_items")).alias("news_count"),
            F.when(~has_news, F.lit("no news")).alias("error"),
            F.col("results"),
            F.when(has_news, F.col("recommended")).alias("recommended"),
        ).alias("prediction"),
    )
