"""Queries: files, projections, deduplication, joins, counts and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.functions import text as X
from ticktide.functions import vectors as V
from ticktide.functions.display import threshold_signal
from ticktide.operators import metrics as M
from ticktide.operators import panel as P
from ticktide.operators import scaling as S
from ticktide.operators import serving as G
from ticktide.plans.dataset import modelling_panel
from ticktide.plans.oracle import pack as sql_pack
from ticktide.plans.oracle import STOPPED, tokens_sql, with_views
from ticktide.plans.registry import pack, query, r
from ticktide.session import scratch
from ticktide.sources import files as IO
from ticktide.sources.tables import Tables

MODELS = {"lstm": 1, "rf": 2, "svm": 3}


def panel(t: Tables) -> DataFrame:
    return modelling_panel(t.news(), t.doc_vec(), t.prices())


def kept_news(t: Tables) -> DataFrame:
    return P.shift_target_date(P.dedup_news(t.news()))


def with_scores(rows: DataFrame) -> DataFrame:
    """Panel rows with a made score per model: a rounded, clipped element of the vector."""
    scores = F.array(*[
        F.struct(F.lit(m).alias("model"), F.least(F.greatest(F.round(F.col("vec")[i] * 2 + 0.5, 3), F.lit(0.0)), F.lit(1.0)).alias("y_prob"))
        for m, i in MODELS.items()
    ])
    kept = [c for c in ("Stock", "Target_Date", "split") if c in rows.columns]
    return rows.select(*kept, F.col("Target_Label").alias("y_true"), F.inline(scores))


def scored(t: Tables) -> DataFrame:
    return with_scores(panel(t))


def panel_once(t: Tables) -> DataFrame:
    return t.once("panel", lambda: panel(t))


def scored_once(t: Tables) -> DataFrame:
    """For queries that read the scores in several branches."""
    return with_scores(panel_once(t))


PANEL_SQL = "Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, Open, Prev_Close, High, Low, Close, Volume, Target_Label"

# ---- files --------------------------------------------------------------------------


@query("s1_read_news", with_views("news", "SELECT Stock, CAST(Date AS VARCHAR) AS Date, Title, Source, Link FROM news"))
def read_news(t: Tables) -> DataFrame:
    path = scratch(t.spark, "news")
    IO.write_news_csv(t.news().select("Stock", F.col("Date").cast("string"), "Title", "Source", "Link"), path)
    return IO.read_news(t.spark, path)


@query("s2_read_prices", with_views("prices", "SELECT Stock, CAST(Date AS VARCHAR) AS Date, Open, High, Low, Close, Volume FROM prices"))
def read_prices(t: Tables) -> DataFrame:
    path = scratch(t.spark, "prices")
    bars = t.prices().select("Date", F.concat("Stock", F.lit(".BK")).alias("Ticker"), *P.BAR_COLUMNS)
    bars.write.option("header", True).csv(path)
    return IO.read_prices(t.spark, path)


@query("s3_read_dataset", with_views("cells", f"SELECT {PANEL_SQL}, {sql_pack('m')} AS vec FROM cells GROUP BY ALL"))
def read_dataset(t: Tables) -> DataFrame:
    path = scratch(t.spark, "dataset")
    rows = panel(t).drop("n_news")
    wide = V.vector_to_columns(rows, V.dimension(rows))
    wide.write.option("header", True).csv(path)
    return IO.read_dataset(t.spark, path).withColumn("vec", pack("vec"))


@query("s4_write_dataset", with_views("cells", f"SELECT {PANEL_SQL}, {sql_pack('m')} AS vec FROM cells GROUP BY ALL"))
def write_dataset(t: Tables) -> DataFrame:
    path = scratch(t.spark, "panel")
    IO.write_dataset(panel(t).drop("n_news"), path)
    return t.spark.read.parquet(path).drop("year").withColumn("vec", pack("vec"))


@query("s5_write_news_csv", with_views("news", "SELECT Stock, count(*) AS n, count(DISTINCT Title) AS titles, CAST(sum(length(Title)) AS BIGINT) AS chars FROM news GROUP BY Stock"))
def write_news_csv(t: Tables) -> DataFrame:
    path = scratch(t.spark, "export")
    IO.write_news_csv(t.news().select("Stock", F.col("Date").cast("string"), "Title", "Source", "Link"), path)
    back = IO.read_news(t.spark, path)
    return back.groupBy("Stock").agg(F.count("*").alias("n"), F.countDistinct("Title").alias("titles"), F.sum(F.length("Title")).alias("chars"))


@query("s7_report_io", with_views("report", "SELECT model, Stock, n_test, accuracy, f1_score, auc_roc, precision_up, recall_up FROM report"))
def report_io(t: Tables) -> DataFrame:
    path = scratch(t.spark, "reports")
    report = M.train_report(scored_once(t)).withColumn("y_prob", F.array(F.lit(0.0)))
    for m in MODELS:
        IO.write_report(report.filter(F.col("model") == m), f"{path}/{m}")
    paths = {m: f"{path}/{m}" for m in (*MODELS, "gru")}  # the last one was never written
    back = IO.read_reports(t.spark, paths, "Stock string, n_test bigint, accuracy double, f1_score double, auc_roc double, precision_up double, recall_up double")
    return back.select("model", "Stock", "n_test", "accuracy", "f1_score", "auc_roc", "precision_up", "recall_up")


@query("s9_fetch_plan", with_views("symbols", """SELECT Stock, CAST(CAST(s AS DATE) AS VARCHAR) AS start, CAST(last_day(s) AS VARCHAR) AS "end", q AS query,
  'https://news.google.com/rss/search?q=' || q || '+after:' || CAST(CAST(s AS DATE) AS VARCHAR) || '+before:' || CAST(last_day(s) AS VARCHAR) || '&hl=th&gl=TH&ceid=TH:th' AS url
  FROM (SELECT Stock, url_encode('หุ้น "' || Stock || '"') AS q FROM symbols) CROSS JOIN
  (SELECT unnest(generate_series(DATE '2021-04-01', DATE '2026-03-31', INTERVAL 1 MONTH)) AS s)"""))
def fetch_plan(t: Tables) -> DataFrame:
    return IO.fetch_plan(t.symbols())


# ---- projections --------------------------------------------------------------------


@query("p1_prices_wide_to_long", with_views("prices", "SELECT Stock || '.BK' AS Ticker, CAST(Date AS VARCHAR) AS Date, Open, High, Low, Close, Volume FROM prices"))
def wide_to_long(t: Tables) -> DataFrame:
    return P.wide_to_long(t.prices_wide())


@query("p2_clean_title", with_views("clean", "SELECT id, clean FROM clean"))
def clean_title(t: Tables) -> DataFrame:
    return t.titles().select("id", X.clean_title(F.col("Title")).alias("clean"))


@query("p3_clean_title_serving", with_views("clean_serving", "SELECT id, clean FROM clean_serving"))
def clean_title_serving(t: Tables) -> DataFrame:
    return t.titles().select("id", X.clean_title_serving(F.col("Title")).alias("clean"))


@query("p4_clean_title_legacy", with_views("clean_legacy", "SELECT id, clean FROM clean_legacy"))
def clean_title_legacy(t: Tables) -> DataFrame:
    return t.titles().select("id", X.clean_title_legacy(F.col("Title")).alias("clean"))


TOKENS_SQL = tokens_sql(STOPPED)


@query("p5_filter_tokens", with_views("clean", f"SELECT id, {TOKENS_SQL} AS kept FROM clean"))
def filter_tokens(t: Tables) -> DataFrame:
    return t.titles().select("id", X.filter_tokens(X.clean_title(F.col("Title")), STOPPED).alias("kept"))


@query("f2_normalize_text", with_views("clean", f"SELECT length(clean) AS chars, CAST(count(*) AS BIGINT) AS n, min({TOKENS_SQL}) AS first_kept FROM clean GROUP BY 1"))
def normalize_text(t: Tables) -> DataFrame:
    clean = X.clean_title(F.col("Title"))
    return (
        t.titles().select(F.length(clean).cast("bigint").alias("chars"), X.filter_tokens(clean, STOPPED).alias("kept"))
        .groupBy("chars").agg(F.count("*").alias("n"), F.min("kept").alias("first_kept"))
    )


@query("p6_token_preview", with_views("kept clean", f"""SELECT CAST(Date AS VARCHAR) AS Date, Stock, Title, {TOKENS_SQL} AS Processed_Title
  FROM (SELECT n.*, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN contains(Title, ' | ')
  THEN regexp_extract(Title, '(?s)^(.*) \\| ', 1) ELSE Title END), '{X.TAG}', '', 'g'), '{X.URL}', '', 'g'), '{X.NOT_WORD}', '', 'g'), '[{X.SPACE}]+', ' ', 'g')) AS clean
  FROM news n) ORDER BY news_id LIMIT 3"""))
def token_preview(t: Tables) -> DataFrame:
    shown = t.news().orderBy("news_id").limit(3)
    return shown.select("Date", "Stock", "Title", X.filter_tokens(X.clean_title(F.col("Title")), STOPPED).alias("Processed_Title"))


@query("p7_split_headline_source", with_views("titles", """SELECT id, CASE WHEN contains(Title, ' - ') THEN regexp_extract(Title, '(?s)^(.*) - ', 1) ELSE Title END AS headline,
  CASE WHEN contains(Title, ' - ') THEN regexp_extract(Title, '(?s)^.* - (.*)$', 1) ELSE 'Google News' END AS source FROM titles"""))
def split_headline_source(t: Tables) -> DataFrame:
    headline, source = X.split_headline(F.col("Title"))
    return t.titles().select("id", headline.alias("headline"), source.alias("source"))


@query("p8_parse_published", with_views("published", """SELECT event_id, published,
  coalesce(strftime(try_strptime(published, '%a, %d %b %Y %H:%M:%S GMT'), '%Y-%m-%d %H:%M:%S'), published) AS "date",
  coalesce(strftime(try_strptime(published, '%a, %d %b %Y %H:%M:%S GMT'), '%Y-%m-%d %H:%M'), 'now') AS shown FROM published"""))
def parse_published(t: Tables) -> DataFrame:
    c = F.col("published")
    return t.published().select(
        "event_id", "published", X.published_text(c).alias("date"),
        X.published_text(c, "yyyy-MM-dd HH:mm", F.lit("now")).alias("shown"),
    )


@query("p9_default_source", """SELECT doc_id, coalesce(nullif(source, 'src0'), 'N/A') AS collected, coalesce(nullif(source, 'src0'), 'Google News') AS polled FROM documents""")
def default_source(t: Tables) -> DataFrame:
    s = F.nullif(F.col("source"), F.lit("src0"))
    return t.read("documents").select("doc_id", X.default_source(s, "N/A").alias("collected"), X.default_source(s, "Google News").alias("polled"))


@query("p10_shift_target_date", with_views("news", "SELECT news_id, Stock, CAST(Date + 1 AS VARCHAR) AS Target_Date, CAST(Date AS VARCHAR) AS Same_Day FROM news"))
def shift_target_date(t: Tables) -> DataFrame:
    return P.shift_target_date(t.news()).select("news_id", "Stock", "Target_Date", P.target_date(F.col("Date"), 0).alias("Same_Day"))


@query("p11_nan_to_num", f"""SELECT vec_id, {sql_pack('z')} AS vec FROM (SELECT vec_id, pos, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END AS z FROM
  (SELECT vec_id, pos, CASE WHEN x > 0.2 THEN 'NaN'::DOUBLE WHEN x < -0.25 THEN '-inf'::DOUBLE WHEN x < -0.2 THEN NULL ELSE x END AS x FROM
  (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings))) GROUP BY vec_id""")
def nan_to_num(t: Tables) -> DataFrame:
    spoiled = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(x > 0.2, F.lit(float("nan"))).when(x < -0.25, F.lit(float("-inf"))).when(x < -0.2, F.lit(None).cast("double")).otherwise(x),
    )
    return t.read("embeddings").select("vec_id", pack(V.nan_to_num(spoiled)).alias("vec"))


@query("p12_vector_columns", with_views("vectors", f"SELECT vec_id, {sql_pack('x')} AS vec, any_value(x) FILTER (pos = 0) AS first, any_value(x) FILTER (pos = (SELECT max(pos) FROM vectors)) AS last FROM vectors GROUP BY vec_id"))
def vector_columns(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    wide = V.vector_to_columns(rows, V.dimension(rows))
    back = V.columns_to_vector(wide)
    return back.select("vec_id", pack("vec").alias("vec"), F.col("vec")[0].alias("first"), F.element_at("vec", -1).alias("last"))


@query("p13_assemble_features", with_views("cells", f"""SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, {sql_pack('m')} AS features FROM (
  SELECT Stock, Target_Date, pos, m FROM cells UNION ALL SELECT DISTINCT Stock, Target_Date, 1000 + k, CASE k WHEN 0 THEN Open WHEN 1 THEN Prev_Close
  WHEN 2 THEN High WHEN 3 THEN Low WHEN 4 THEN Close ELSE Volume END FROM cells CROSS JOIN generate_series(0, 5) AS g(k)) GROUP BY Stock, Target_Date"""))
def assemble_features(t: Tables) -> DataFrame:
    return panel(t).select("Stock", "Target_Date", pack(V.assemble_features("vec", P.PRICE_COLUMNS)).alias("features"))


@query("p14_threshold_signal", with_views("scored", """SELECT model, Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, CAST(printf('%.4f', CAST(y_prob AS DOUBLE)) AS DOUBLE) AS probability_up,
  CAST(printf('%.4f', CAST(CASE WHEN y_prob >= 0.5 THEN y_prob ELSE 1 - y_prob END AS DOUBLE)) AS DOUBLE) AS confidence, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS signal,
  CASE WHEN y_prob >= 0.5 THEN 'Up' ELSE 'Down' END AS label FROM scored"""))
def threshold(t: Tables) -> DataFrame:
    out = threshold_signal(F.col("y_prob"))
    return scored(t).select("model", "Stock", "Target_Date", *[c.alias(n) for n, c in out.items()])


# ---- sort, limit, top-k, dedup ------------------------------------------------------


@query("d1_dedup_news", with_views("kept", "SELECT news_id, Stock, CAST(Date AS VARCHAR) AS Date, Title, Source, Link FROM kept"))
def dedup_news(t: Tables) -> DataFrame:
    return P.dedup_news(t.news()).select("news_id", "Stock", "Date", "Title", "Source", "Link")


@query("d2_sort_news", with_views("kept", "SELECT Stock, CAST(Date AS VARCHAR) AS Date, news_id, Link FROM kept ORDER BY Stock, Date DESC, news_id"))
def sort_news(t: Tables) -> DataFrame:
    return P.sort_news(P.dedup_news(t.news()).select("Stock", "Date", "news_id", "Link"))


@query("d3_sort_panel", with_views("labelled", "SELECT Stock, CAST(Date AS VARCHAR) AS Date, Open, Close, Target_Label FROM labelled ORDER BY Stock, Date"))
def sort_panel(t: Tables) -> DataFrame:
    return P.sort_panel(P.label_open_direction(t.prices()).select("Stock", "Date", "Open", "Close", "Target_Label"), date="Date")


@query("d4_latest_n_per_symbol", with_views("feed_items", "SELECT Stock, headline, source, date, link, item_rank FROM feed_items WHERE item_rank <= 10"))
def latest_n(t: Tables) -> DataFrame:
    return feed_items(t, 10).select("Stock", "headline", "source", "date", "link", "item_rank")


def feed_items(t: Tables, n: int) -> DataFrame:
    feed = t.feed().withColumnsRenamed({"Title": "headline", "event_type": "source", "Link": "link"})
    newest = P.latest_n_per_symbol(feed, n, [F.desc("ts"), F.asc("item_id")])
    days = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))  # times carry no zone
    seconds = days * 86400.0 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts")).cast("double")
    return newest.select("Stock", "headline", "source", F.date_format("ts", "yyyy-MM-dd").alias("date"), "link", seconds.alias("timestamp"), "item_rank")


@query("d6_head_tail", with_views("prices", """SELECT * FROM (SELECT CAST(Date AS VARCHAR) AS Date, Stock, Open, Close, 'head' AS part FROM prices ORDER BY prices.Date, Stock LIMIT 10)
  UNION ALL SELECT * FROM (SELECT CAST(Date AS VARCHAR) AS Date, Stock, Open, Close, 'tail' AS part FROM prices ORDER BY prices.Date DESC, Stock DESC LIMIT 10)"""))
def head_tail(t: Tables) -> DataFrame:
    return P.head_tail(t.prices().select("Date", "Stock", "Open", "Close"), ["Date", "Stock"], 10)


# ---- joins --------------------------------------------------------------------------


@query("j1_join_news_prices", with_views("cells", f"SELECT {PANEL_SQL}, n_news, {sql_pack('m')} AS vec FROM cells GROUP BY ALL"))
def join_news_prices(t: Tables) -> DataFrame:
    return panel(t).withColumn("vec", pack("vec"))


@query("j2_join_articles_labels", with_views("kept labelled", """SELECT news_id, k.Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, Target_Label
  FROM kept k JOIN labelled l ON l.Stock = k.Stock AND l.Date = k.Target_Date"""))
def join_articles_labels(t: Tables) -> DataFrame:
    articles = kept_news(t).select("news_id", "Stock", "Target_Date")
    return P.join_articles_labels(articles, P.label_open_direction(t.prices()))


@query("u1_union_symbols", with_views("labelled", "SELECT Stock, CAST(Date AS VARCHAR) AS Target_Date, Open, Prev_Close, Target_Label FROM labelled"))
def union_symbols(t: Tables) -> DataFrame:
    bars = t.prices()
    first = F.col("Stock") < "ASIA"
    return P.union_symbols([bars.filter(first), bars.filter(~first)])


# ---- counts -------------------------------------------------------------------------


@query("a1_mean_pool_vectors", with_views("pooled", f"SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, {sql_pack('m')} AS vec, any_value(n_news) AS n_news FROM pooled GROUP BY Stock, Target_Date"))
def mean_pool(t: Tables) -> DataFrame:
    return P.mean_pool(kept_news(t).select("news_id", "Stock", "Target_Date").join(t.doc_vec(), "news_id")).withColumn("vec", pack("vec"))


@query("f3_group_apply", with_views("pooled", "SELECT Stock, count(DISTINCT Target_Date) AS days, round(sum(m) / count(DISTINCT Target_Date), 6) AS mean_sum FROM pooled GROUP BY Stock"))
def group_apply(t: Tables) -> DataFrame:
    pooled = P.mean_pool(kept_news(t).select("news_id", "Stock", "Target_Date").join(t.doc_vec(), "news_id"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return pooled.groupBy("Stock").agg(F.count("*").alias("days"), r(F.avg(total)).alias("mean_sum"))


@query("a2_value_counts", with_views("labelled kept", """SELECT Stock AS key, 'news' AS what, count(*) AS n FROM kept GROUP BY Stock
  UNION ALL SELECT CAST(Target_Label AS VARCHAR), 'label', count(*) FROM labelled GROUP BY Target_Label"""))
def value_counts(t: Tables) -> DataFrame:
    news = P.value_counts(P.dedup_news(t.news()), "Stock").select(F.col("Stock").alias("key"), F.lit("news").alias("what"), "n")
    labels = P.value_counts(P.label_open_direction(t.prices()), "Target_Label")
    return news.unionByName(labels.select(F.col("Target_Label").cast("string").alias("key"), F.lit("label").alias("what"), "n"))


@query("a3_rows_per_stock", with_views("panel", """SELECT Stock, count(*) AS n, CAST(count(*) >= 60 AS INTEGER) AS enough_60, CAST(count(*) >= 90 AS INTEGER) AS enough_90 FROM panel GROUP BY Stock"""))
def rows_per_stock(t: Tables) -> DataFrame:
    p = P.rows_per_stock(panel(t)).withColumnRenamed("enough", "enough_60")
    return p.withColumn("enough_90", F.col("n") >= 90)


@query("a4_up_ratio", with_views("split", "SELECT Stock, round(avg(Target_Label), 6) AS up_ratio, count(*) AS n_train FROM split WHERE split = 'train' GROUP BY Stock"))
def up_ratio(t: Tables) -> DataFrame:
    return M.up_ratio(P.chrono_split(panel(t))).withColumn("up_ratio", r("up_ratio"))


@query("a5_class_weights", with_views("split", """SELECT Stock, round(n / (2.0 * n0), 6) AS weight_0, round(n / (2.0 * n1), 6) AS weight_1 FROM (
  SELECT Stock, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (Target_Label = 0) AS n0, count(*) FILTER (Target_Label = 1) AS n1 FROM split WHERE split = 'train' GROUP BY Stock) WHERE n0 > 0 AND n1 > 0"""))
def class_weights(t: Tables) -> DataFrame:
    train = P.chrono_split(panel(t)).filter("split = 'train'")
    return M.class_weights(train).select("Stock", r("weight_0"), r("weight_1"))


@query("a6_scale_pos_weight", with_views("split", """SELECT Stock, CASE WHEN n1 = 0 THEN 1.0 ELSE CAST(printf('%.4f', CAST(n0 / n1 AS DOUBLE)) AS DOUBLE) END AS scale_pos_weight FROM (
  SELECT Stock, CAST(count(*) FILTER (Target_Label = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (Target_Label = 1) AS DOUBLE) AS n1 FROM split WHERE split = 'train' GROUP BY Stock)"""))
def scale_pos_weight(t: Tables) -> DataFrame:
    return M.scale_pos_weight(P.chrono_split(panel(t)).filter("split = 'train'"))


# ---- windows ------------------------------------------------------------------------


@query("w1_label_open_direction", with_views("labelled", "SELECT Stock, CAST(Date AS VARCHAR) AS Date, Open, Close, High, Low, Volume, Prev_Close, Target_Label FROM labelled"))
def label_open_direction(t: Tables) -> DataFrame:
    return P.label_open_direction(t.prices())


@query("w2_chrono_split", with_views("split", "SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, rn, n_rows, split FROM split"))
def chrono_split(t: Tables) -> DataFrame:
    return P.chrono_split(panel(t).select("Stock", "Target_Date"))


SEQUENCE_SQL = """SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, Target_Label, rn - {w} AS seq_no, split, seq AS sequence FROM (
  SELECT *, count(*) FILTER (split = 'train') OVER (PARTITION BY Stock) AS ntr, count(*) FILTER (split = 'test') OVER (PARTITION BY Stock) AS nte FROM (
  SELECT *, CASE WHEN rn - {w} <= greatest(CAST(floor(n_rows * CAST(0.7 AS DOUBLE)) AS INTEGER) - 1, 1) THEN 'train'
    WHEN rn - {w} <= greatest(CAST(floor(n_rows * CAST(0.7 AS DOUBLE)) AS INTEGER) - 1, 1) + CAST(floor(n_rows * CAST(0.15 AS DOUBLE)) AS INTEGER) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT Stock, Target_Date, Target_Label, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(count(*) OVER (PARTITION BY Stock) AS INTEGER) AS n_rows,
    {seq} AS seq FROM (SELECT *, array_to_string(list_transform(list_concat(vec, [Open, Prev_Close, High, Low, Close, CAST(Volume AS DOUBLE)]),
      lambda x: CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR)), ',') AS e FROM panel)
    WINDOW w AS (PARTITION BY Stock ORDER BY Target_Date))
  WHERE rn > {w})) WHERE ntr >= 10 AND nte >= 5"""


def _sequences(t: Tables, window: int) -> DataFrame:
    features = panel(t).select("Stock", "Target_Date", "Target_Label", F.concat("vec", F.array(*[F.col(c).cast("double") for c in ("Open", "Prev_Close", "High", "Low", "Close", "Volume")])).alias("features"))
    seq = P.sliding_sequences(features, window=window)
    return seq.select("Stock", "Target_Date", "Target_Label", "seq_no", "split", F.array_join(F.transform("sequence", pack), ";").alias("sequence"))


@query("w3_sliding_sequences", with_views("panel", SEQUENCE_SQL.format(w=1, seq="lag(e) OVER w")))
def sliding_sequences(t: Tables) -> DataFrame:
    return _sequences(t, 1)


@query("w3_sliding_sequences_3", with_views("panel", SEQUENCE_SQL.format(
    w=3, seq="lag(e, 3) OVER w || ';' || lag(e, 2) OVER w || ';' || lag(e) OVER w")))
def sliding_sequences_3(t: Tables) -> DataFrame:
    return _sequences(t, 3)


@query("w6_global_train_cutoff", with_views("cutoff kept", "SELECT news_id, CAST(Target_Date AS VARCHAR) AS Target_Date, CAST(Target_Date <= (SELECT cutoff FROM cutoff) AS INTEGER) AS is_train FROM kept"))
def global_train_cutoff(t: Tables) -> DataFrame:
    return P.global_train_split(kept_news(t).select("news_id", "Target_Date"))


# ---- scaling and folds --------------------------------------------------------------


@query("m1_standard_scale", with_views("split cells", f"""SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, split, {sql_pack('z')} AS features FROM (
  SELECT Stock, Target_Date, split, pos, (v - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM (
  SELECT *, avg(v) FILTER (split = 'train') OVER (PARTITION BY Stock, pos) AS mu, stddev_pop(v) FILTER (split = 'train') OVER (PARTITION BY Stock, pos) AS sd
  FROM long)) GROUP BY Stock, Target_Date, split""", long="""SELECT s.Stock, s.Target_Date, s.split, c.pos, c.m AS v FROM split s JOIN cells c ON c.Stock = s.Stock AND c.Target_Date = s.Target_Date
  UNION ALL SELECT Stock, Target_Date, split, 1000 + k, CASE k WHEN 0 THEN Open WHEN 1 THEN Prev_Close WHEN 2 THEN High WHEN 3 THEN Low WHEN 4 THEN Close ELSE Volume END
  FROM split CROSS JOIN generate_series(0, 5) AS g(k)"""))
def standard_scale(t: Tables) -> DataFrame:
    parts = P.chrono_split(panel(t)).withColumn("features", V.assemble_features("vec", P.PRICE_COLUMNS))
    rows = parts.select("Stock", "Target_Date", "split", "features")
    return S.standard_scale(rows, "features", train=F.col("split") == "train").withColumn("features", pack("features"))


@query("m6_time_series_folds", with_views("panel", """SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, CAST(f AS INTEGER) AS fold, CASE WHEN i < n - (5 - f) * sz THEN 'train' ELSE 'test' END AS role FROM (
  SELECT Stock, Target_Date, row_number() OVER (PARTITION BY Stock ORDER BY Target_Date) - 1 AS i, count(*) OVER (PARTITION BY Stock) AS n, count(*) OVER (PARTITION BY Stock) // 6 AS sz FROM panel)
  CROSS JOIN generate_series(0, 4) AS g(f) WHERE i < n - (5 - f) * sz + sz"""))
def time_series_folds(t: Tables) -> DataFrame:
    return M.time_series_folds(panel(t).select("Stock", "Target_Date"))


FOLDS_SQL = """SELECT {cols}, CAST((SELECT count(*) FROM generate_series(0, 3) AS g(i) WHERE rk >= (
  SELECT count(*) FROM generate_series(0, 4000) AS p(q) WHERE q >= st AND q < st + nc AND q % 5 <= i)) AS INTEGER) AS fold FROM (
  SELECT *, row_number() OVER (PARTITION BY {grp}, Target_Label ORDER BY {order}) - 1 AS rk, count(*) OVER (PARTITION BY {grp}, Target_Label) AS nc,
  CASE WHEN Target_Label = arg_min(Target_Label, Target_Date) OVER (PARTITION BY {grp}) THEN 0 ELSE count(*) OVER (PARTITION BY {grp}) - count(*) OVER (PARTITION BY {grp}, Target_Label) END AS st
  FROM {src})"""


@query("m7_stratified_folds", with_views("panel", FOLDS_SQL.format(cols="Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, Target_Label", grp="Stock", order="Target_Date", src="panel")))
def stratified_folds(t: Tables) -> DataFrame:
    return M.stratified_folds(panel(t).select("Stock", "Target_Date", "Target_Label"), F.col("Target_Date"))


# ---- quotes -------------------------------------------------------------------------


@query("w4_latest_quote", with_views("quotes", "SELECT Stock, price, change, CAST(is_positive AS INTEGER) AS is_positive FROM quotes"))
def latest_quote(t: Tables) -> DataFrame:
    return G.latest_quote(t.symbols(), t.prices())


@query("w5_price_history", with_views("last_bars", "SELECT Stock, CAST(Date AS VARCHAR) AS Date, CAST(printf('%.2f', CAST(Close AS DOUBLE)) AS DOUBLE) AS close, back FROM last_bars WHERE back <= 30"))
def price_history(t: Tables) -> DataFrame:
    return G.price_history(t.prices())


@query("p16_sparkline_points", with_views("last_bars", """SELECT Stock, CAST(Date AS VARCHAR) AS Date, round(CASE WHEN n < 2 THEN 0 ELSE (n - back) / (n - 1) END, 6) AS x,
  round(CASE WHEN n < 2 THEN 0.5 ELSE (c - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END END, 6) AS y FROM (
  SELECT *, min(c) OVER (PARTITION BY Stock) AS lo, max(c) OVER (PARTITION BY Stock) AS hi, count(*) OVER (PARTITION BY Stock) AS n
  FROM (SELECT *, CAST(printf('%.2f', CAST(Close AS DOUBLE)) AS DOUBLE) AS c FROM last_bars WHERE back <= 30))"""))
def sparkline_points(t: Tables) -> DataFrame:
    return G.sparkline_points(G.price_history(t.prices())).select("Stock", "Date", r("x"), r("y"))
