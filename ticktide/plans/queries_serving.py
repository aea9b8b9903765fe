"""Queries: quotes, dashboard, details, feed, snapshot, polling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.functions.display import threshold_signal
from ticktide.operators import metrics as M
from ticktide.operators import panel as P
from ticktide.operators import serving as G
from ticktide.plans.oracle import with_views
from ticktide.plans.queries_panel import MODELS, feed_items, scored_once
from ticktide.plans.registry import query
from ticktide.session import scratch
from ticktide.sources import files as IO
from ticktide.sources.tables import Tables


def latest_signal(t: Tables) -> DataFrame:
    """Per symbol and model the signal of the newest day."""
    newest = P.latest_n_per_symbol(
        scored_once(t).withColumn("_key", F.concat_ws("|", "Stock", "model")), 1, [F.desc("Target_Date")], stock="_key"
    )
    out = threshold_signal(F.col("y_prob"))
    return newest.select("Stock", "model", "Target_Date", *[c.alias(n) for n, c in out.items()])


def ranked_report(t: Tables) -> DataFrame:
    """The report of all models with the order they are listed in."""
    listed = F.array(*map(F.lit, MODELS))
    return M.train_report(scored_once(t)).withColumn("model_rank", F.array_position(listed, F.col("model")))


def best_result(t: Tables) -> DataFrame:
    results = latest_signal(t).withColumn("updated_at", F.concat(F.col("Target_Date").cast("string"), F.lit("T08:30:00")))
    return M.pick_best_model(ranked_report(t), results.drop("Target_Date"), t.symbols())


BEST = """SELECT s.Stock, coalesce(b.model, 'lstm') AS model FROM symbols s LEFT JOIN (
  SELECT Stock, model FROM (SELECT *, row_number() OVER (PARTITION BY Stock ORDER BY auc_roc DESC, CASE model WHEN 'lstm' THEN 0 WHEN 'rf' THEN 1 ELSE 2 END) AS k FROM report) WHERE k = 1) b ON b.Stock = s.Stock"""
CHOSEN = """SELECT b.Stock, b.model, x.signal, x.label, x.probability_up, x.confidence, CAST(x.Target_Date AS VARCHAR) || 'T08:30:00' AS updated_at
  FROM best b LEFT JOIN latest_signal x ON x.Stock = b.Stock AND x.model = b.model"""


@query("m12_pick_best_model", with_views("symbols report latest_signal", "SELECT * FROM chosen", best=BEST, chosen=CHOSEN))
def pick_best_model(t: Tables) -> DataFrame:
    return best_result(t).select("Stock", "model", "signal", "label", "probability_up", "confidence", "updated_at")


@query("p15_format_signal", with_views("latest_signal", """SELECT Stock, model, signal, label, printf('%.1f%%', probability_up * 100) AS prob, printf('%.1f%%', confidence * 100) AS confidence,
  printf('%.0f%%', latest_signal.confidence * 100) AS confidence_short FROM latest_signal"""))
def format_signal(t: Tables) -> DataFrame:
    return G.format_signal(latest_signal(t))


DASHBOARD = """SELECT s.Stock, s.name, q.price, q.change, CAST(CASE WHEN c.signal IS NOT NULL THEN c.signal = 1 ELSE q.is_positive END AS INTEGER) AS is_positive,
  CASE WHEN c.signal IS NULL THEN 'รอผลจากโมเดล' ELSE (CASE WHEN c.signal = 1 THEN 'ขึ้น' ELSE 'ลง' END) || ' (' || printf('%.0f%%', c.confidence * 100) || ')' END AS sentiment,
  coalesce(c.updated_at, '-') AS updated_at FROM symbols s LEFT JOIN quotes q ON q.Stock = s.Stock LEFT JOIN chosen c ON c.Stock = s.Stock"""


@query("j4_dashboard", with_views("symbols quotes report latest_signal", DASHBOARD, best=BEST, chosen=CHOSEN))
def dashboard(t: Tables) -> DataFrame:
    return G.dashboard(t.symbols(), G.latest_quote(t.symbols(), t.prices()), best_result(t))


def stored_items(t: Tables) -> DataFrame:
    """News of the symbols with at least the mean number of items is stored; some of its items have no timestamp."""
    sizes = t.feed().groupBy("Stock").count()
    stored = sizes.filter(F.col("count") >= sizes.agg(F.avg("count")).scalar())
    items = feed_items(t, 10).join(stored.select("Stock"), "Stock", "left_semi")
    return items.withColumn("timestamp", F.when(F.col("source") != "view", F.col("timestamp")))


DETAIL = """SELECT s.Stock, s.name, q.price, q.change, CAST(q.is_positive AS INTEGER) AS is_positive,
  l.signal AS lstm_signal, coalesce(l.label, '-') AS lstm_label, printf('%.1f%%', coalesce(l.probability_up, 0) * 100) AS lstm_prob, printf('%.1f%%', coalesce(l.confidence, 0) * 100) AS lstm_confidence,
  f.signal AS rf_signal, coalesce(f.label, '-') AS rf_label, printf('%.1f%%', coalesce(f.probability_up, 0) * 100) AS rf_prob, printf('%.1f%%', coalesce(f.confidence, 0) * 100) AS rf_confidence,
  upper(c.model) AS recommended_model, coalesce(c.label, '-') AS recommended_label, printf('%.1f%%', coalesce(c.confidence, 0) * 100) AS recommended_conf,
  coalesce(c.updated_at, 'ยังไม่มีข้อมูล') AS updated_at, n.news, h.history
  FROM symbols s LEFT JOIN quotes q ON q.Stock = s.Stock LEFT JOIN chosen c ON c.Stock = s.Stock
  LEFT JOIN latest_signal l ON l.Stock = s.Stock AND l.model = 'lstm' LEFT JOIN latest_signal f ON f.Stock = s.Stock AND f.model = 'rf'
  LEFT JOIN (SELECT Stock, string_agg(item_rank || ' ' || headline || ' ' || source || ' ' || date || ' ' || link, ';' ORDER BY item_rank) AS news FROM shown GROUP BY Stock) n ON n.Stock = s.Stock
  LEFT JOIN (SELECT Stock, string_agg(CAST(Date AS VARCHAR) || ' ' || printf('%.2f', Close), ';' ORDER BY Date) AS history FROM last_bars WHERE back <= 30 GROUP BY Stock) h ON h.Stock = s.Stock
  WHERE s.Stock = '{symbol}'"""
SHOWN = """SELECT Stock, headline, source, date, link, item_rank FROM stored_items UNION ALL
  SELECT Stock, headline, source, date, link, item_rank FROM feed_items WHERE item_rank <= 5 AND Stock NOT IN (SELECT Stock FROM stored_items)"""


def bars(t: Tables) -> DataFrame:
    return t.once("prices", t.prices)


def detail(t: Tables, symbol: str) -> DataFrame:
    page = G.stock_detail(
        symbol, t.symbols(), G.latest_quote(t.symbols(), bars(t)), latest_signal(t), best_result(t),
        stored_items(t), feed_items(t, 10), G.price_history(bars(t)),
    )
    item = lambda n: F.concat_ws(" ", n["item_rank"].cast("string"), n["headline"], n["source"], n["date"], n["link"])
    day = lambda h: F.concat_ws(" ", h["date"].cast("string"), G.fixed(h["close"], 2))
    return page.withColumn("news", F.array_join(F.transform("news", item), ";")).withColumn("history", F.array_join(F.transform("history", day), ";"))


for _name, _symbol in (("j5_stock_detail", "asia"), ("j5_stock_detail_fresh", "Middle East"), ("j5_stock_detail_unknown", "nowhere")):
    query(_name, with_views("symbols quotes report latest_signal stored_items feed_items last_bars", DETAIL.format(symbol=_symbol.upper()), best=BEST, chosen=CHOSEN, shown=SHOWN))(
        lambda t, symbol=_symbol: detail(t, symbol)
    )


FEED = """SELECT Stock, headline, source, date, link, round(timestamp, 3) AS timestamp, item_rank FROM (SELECT * FROM stored_items UNION ALL
  SELECT * FROM feed_items WHERE item_rank <= 3 AND Stock NOT IN (SELECT Stock FROM stored_items)) {where}"""


def feed(t: Tables) -> DataFrame:
    merged = G.merged_feed(t.symbols(), stored_items(t), feed_items(t, 10))
    return merged.select("Stock", "headline", "source", "date", "link", F.round("timestamp", 3).alias("timestamp"), "item_rank")


@query("d5_merged_feed", with_views("stored_items feed_items", FEED.format(where="")))
def merged_feed(t: Tables) -> DataFrame:
    return feed(t)


@query("p17_filter_feed_by_symbol", with_views("stored_items feed_items", FEED.format(where="WHERE Stock = 'EUROPE'")))
def filter_feed(t: Tables) -> DataFrame:
    return G.filter_feed(feed(t), "EUROPE")


# ---- snapshot -----------------------------------------------------------------------


def snapshot(t: Tables) -> DataFrame:
    """One nested record per symbol: stored news and both models' results."""
    results = latest_signal(t).groupBy("Stock").agg(
        F.array_sort(F.collect_list(F.struct("model", "probability_up", "confidence", "signal", "label"))).alias("results")
    )
    items = stored_items(t).groupBy("Stock").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item_rank", "headline", "source", "date", "link"))),
                    lambda n: F.struct(n["headline"].alias("headline"), n["source"].alias("source"), n["date"].alias("date"), n["link"].alias("link"))).alias("news")
    )
    best = best_result(t).select("Stock", "updated_at", F.struct("model", "probability_up", "confidence", "signal", "label").alias("recommended"))
    joined = t.symbols().select("Stock").join(results, "Stock", "left").join(items, "Stock", "left").join(best, "Stock", "left")
    error = F.when(F.col("news").isNull(), F.lit("no news"))
    return joined.select(
        "Stock", "updated_at", F.substring("updated_at", 1, 10).alias("date"), "news",
        F.struct(F.size("news").alias("news_count"), error.alias("error"), "results", "recommended").alias("prediction"),
    )


@query("s8_prediction_snapshot", with_views("symbols report latest_signal stored_items", """SELECT c.Stock, left(c.updated_at, 10) AS date, CAST(coalesce(n.n, -1) AS INTEGER) AS news_count,
  CASE WHEN n.n IS NULL THEN 'no news' END AS error, coalesce(r.results, '') AS results, c.model AS recommended, c.label AS label
  FROM chosen c LEFT JOIN (SELECT Stock, count(*) AS n FROM stored_items GROUP BY Stock) n ON n.Stock = c.Stock
  LEFT JOIN (SELECT Stock, string_agg(model || ' ' || label, ';' ORDER BY model) AS results FROM latest_signal GROUP BY Stock) r ON r.Stock = c.Stock""", best=BEST, chosen=CHOSEN))
def prediction_snapshot(t: Tables) -> DataFrame:
    path = scratch(t.spark, "snapshot")
    IO.write_snapshot(snapshot(t), path)
    back = IO.read_snapshot(t.spark, path)
    p = F.col("prediction")
    shown = F.array_join(F.transform(p["results"], lambda x: F.concat_ws(" ", x["model"], x["label"])), ";")
    return back.select(
        "Stock", "date", F.coalesce(p["news_count"], F.lit(-1)).alias("news_count"), p["error"].alias("error"), F.coalesce(shown, F.lit("")).alias("results"),
        p["recommended"]["model"].alias("recommended"), p["recommended"]["label"].alias("label"),
    )


@query("x4_refresh_if_stale", with_views("symbols report latest_signal", """SELECT CAST(count(*) FILTER (left(updated_at, 10) = (SELECT CAST(max(Target_Date) AS VARCHAR) FROM latest_signal)) = 0 AS INTEGER) AS same_day,
  CAST(count(*) FILTER (left(updated_at, 10) = '1999-01-01') = 0 AS INTEGER) AS later_day FROM chosen""", best=BEST, chosen=CHOSEN))
def refresh_if_stale(t: Tables) -> DataFrame:
    snap = best_result(t).select(F.substring("updated_at", 1, 10).alias("date"))
    last = latest_signal(t).agg(F.max("Target_Date").cast("string").alias("d")).scalar()
    same = G.needs_refresh(snap, last).select(F.col("needs_refresh").alias("same_day"))
    later = G.needs_refresh(snap, F.lit("1999-01-01")).select("needs_refresh").scalar()
    return same.withColumn("later_day", later)
