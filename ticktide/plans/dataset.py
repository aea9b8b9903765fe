"""The modelling panel: news of day T joined to the open direction of day T+1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.operators import panel as P


def modelling_panel(news: DataFrame, doc_vec: DataFrame, prices: DataFrame, shift_days: int = 1, unique: bool = False) -> DataFrame:
    """``unique`` news went through :func:`panel.dedup_news` before and needs no ``Title``."""
    kept = (news if unique else P.dedup_news(news)).select("news_id", "Stock", P.target_date(F.col("Date"), shift_days).alias("Target_Date"))
    pooled = P.mean_pool(kept.join(doc_vec, "news_id"))
    return P.join_news_prices(pooled, P.label_open_direction(prices)).select(
        "Stock", "Target_Date", *P.PRICE_COLUMNS, "Target_Label", "n_news", "vec"
    )
