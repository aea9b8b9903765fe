"""Queries: TF-IDF, embedding of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.functions import text as X
from ticktide.functions.segment import segment
from ticktide.operators import embedding as B
from ticktide.operators import panel as P
from ticktide.operators import tfidf as T
from ticktide.plans.oracle import pack as sql_pack
from ticktide.plans.oracle import STOPPED, STOPPED_TFIDF, tokens_sql, with_views
from ticktide.plans.queries_panel import kept_news
from ticktide.plans.registry import pack, query, r
from ticktide.session import written
from ticktide.sources.tables import Tables


def articles(t: Tables, stopped: Sequence[str] = STOPPED_TFIDF) -> DataFrame:
    words = X.clean_tokens(F.col("Title"), stopped)
    return kept_news(t).select("news_id", "Stock", "Target_Date", words.alias("Processed"))


def articles_once(t: Tables) -> DataFrame:
    """Cleaned articles written once: the split, the fit and the transform all read them."""
    return written(articles(t), "articles")


def train_part(a: DataFrame) -> DataFrame:
    return P.global_train_split(a).filter("is_train")


@query("t1_ngram_counts", with_views("gram_counts", "SELECT news_id, term, tf FROM gram_counts"))
def ngram_counts(t: Tables) -> DataFrame:
    return T.ngram_counts(articles(t), "Processed", "news_id")


@query("t2_tfidf_fit", with_views("vocabulary", "SELECT term, df, cf, round(idf, 6) AS idf FROM vocabulary"))
def tfidf_fit(t: Tables) -> DataFrame:
    return T.tfidf_fit(train_part(articles_once(t))).select("term", "df", "cf", r("idf"))


@query("t3_tfidf_transform", with_views("weights", "SELECT news_id, term, round(weight, 6) AS weight FROM weights"))
def tfidf_transform(t: Tables) -> DataFrame:
    a = articles_once(t)
    return T.tfidf_transform(a, T.tfidf_fit(train_part(a))).select("news_id", "term", r("weight"))


@query("t4_top_idf_terms", with_views("vocabulary", "SELECT term, df, round(idf, 6) AS idf FROM vocabulary ORDER BY vocabulary.idf DESC, term LIMIT 20"))
def top_idf_terms(t: Tables) -> DataFrame:
    return T.top_idf_terms(T.tfidf_fit(train_part(articles_once(t)))).select("term", "df", r("idf"))


@query("t5_top_terms_by_label", with_views("weights articles labelled", """SELECT Target_Label, CAST(place AS INTEGER) AS place, term, round(mw, 6) AS mean_weight, n_articles FROM (
  SELECT *, row_number() OVER (PARTITION BY Target_Label ORDER BY round(mw, 12) DESC, term) AS place FROM (
  SELECT Target_Label, term, sum(weight) / any_value(n_articles) AS mw, any_value(n_articles) AS n_articles FROM labelled_articles JOIN weights USING (news_id)
  JOIN (SELECT Target_Label, count(*) AS n_articles FROM labelled_articles GROUP BY Target_Label) USING (Target_Label) GROUP BY Target_Label, term)) WHERE place <= 10""",
  labelled_articles="SELECT news_id, Target_Label FROM articles a JOIN labelled l ON l.Stock = a.Stock AND l.Date = a.Target_Date"))
def top_terms_by_label(t: Tables) -> DataFrame:
    a = articles_once(t)
    weights = T.tfidf_transform(a, T.tfidf_fit(train_part(a)), "Processed", "news_id", "Stock", "Target_Date")
    return T.top_terms_by_label(a, weights, P.label_open_direction(t.prices())).withColumn("mean_weight", r("mean_weight"))


@query("t6_tfidf_daily_dataset", with_views("weights articles labelled", """SELECT d.Stock, CAST(d.Target_Date AS VARCHAR) AS Target_Date, l.Open, l.Prev_Close, l.Target_Label, d.n_news,
  coalesce(v.tfidf, '') AS tfidf FROM (SELECT Stock, Target_Date, count(*) AS n_news FROM articles GROUP BY ALL) d
  JOIN labelled l ON l.Stock = d.Stock AND l.Date = d.Target_Date
  LEFT JOIN (SELECT Stock, Target_Date, string_agg(term || ':' || CAST(CAST(round(w * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY term) AS tfidf FROM (
    SELECT a.Stock, a.Target_Date, term, sum(weight) / any_value(n) AS w FROM weights JOIN articles a USING (news_id)
    JOIN (SELECT Stock, Target_Date, count(*) AS n FROM articles GROUP BY ALL) c ON c.Stock = a.Stock AND c.Target_Date = a.Target_Date GROUP BY a.Stock, a.Target_Date, term)
    GROUP BY Stock, Target_Date) v ON v.Stock = d.Stock AND v.Target_Date = d.Target_Date"""))
def tfidf_daily_dataset(t: Tables) -> DataFrame:
    out = T.tfidf_daily_dataset(articles_once(t), P.label_open_direction(t.prices()))
    entry = lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 1e6).cast("bigint").cast("string"))
    shown = F.array_join(F.transform(F.map_entries("tfidf"), entry), ",")
    return out.select("Stock", "Target_Date", "Open", "Prev_Close", "Target_Label", "n_news", shown.alias("tfidf"))


# ---- text without blanks ------------------------------------------------------------


def run_together(t: Tables) -> DataFrame:
    """All cleaned titles without their blanks, and their words as the vocabulary of the articles finds them."""
    terms = T.tfidf_fit(train_part(articles_once(t))).select("term").collect()  # bounded by MAX_TERMS
    titles = t.titles().select("id", F.replace(X.clean_title(F.col("Title")), F.lit(" "), F.lit("")).alias("text"))
    return titles.withColumn("words", segment(F.col("text"), [x.term for x in terms if " " not in x.term], "[^ ]"))


@query("p5_segmented_tokens")
def segmented_tokens(t: Tables) -> DataFrame:
    return run_together(t).select("id", X.filter_tokens(F.col("words"), STOPPED).alias("kept"))


@query("p5_segmented_facts", with_views("clean", "SELECT id, CAST(length(replace(clean, ' ', '')) AS BIGINT) AS chars, 1 AS whole FROM clean"))
def segmented_facts(t: Tables) -> DataFrame:
    whole = F.replace("words", F.lit(" "), F.lit("")) == F.col("text")
    return run_together(t).select("id", F.length("text").cast("long").alias("chars"), whole.cast("int").alias("whole"))


# ---- embedding ----------------------------------------------------------------------


def letter_mix():
    """A stand-in for a language model: the share of code points by remainder of 8."""

    def embed(texts: list[str]) -> np.ndarray:
        rows = [np.bincount(np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) % 8, minlength=8) / len(x) for x in texts]
        return np.stack(rows)

    return embed


LETTER_MIX_SQL = """SELECT id, pos, count(c) / any_value(n) AS x FROM (SELECT id, pos, n, c FROM (
  SELECT id, CAST(length(s) AS DOUBLE) AS n, unnest(string_split(s, '')) AS ch FROM (SELECT id, CASE WHEN trim(s) = '' THEN 'ข่าวหุ้น' ELSE s END AS s FROM texts)) t
  CROSS JOIN generate_series(0, 7) AS g(pos) LEFT JOIN (SELECT 1 AS c) o ON unicode(ch) % 8 = pos) GROUP BY id, pos"""


@query("f1_embed_texts", with_views("clean", f"SELECT id, {sql_pack('x')} AS vec FROM mix GROUP BY id", texts=f"SELECT id, {tokens_sql(STOPPED)} AS s FROM clean", mix=LETTER_MIX_SQL))
def embed_texts(t: Tables) -> DataFrame:
    clean = t.titles().select("id", X.filter_tokens(X.clean_title(F.col("Title")), STOPPED).alias("text"))
    return B.embed_texts(clean, letter_mix).select("id", pack("vec").alias("vec"))


@query("j3_embedding_cache", with_views("cleaned", f"SELECT news_id, Stock, {sql_pack('x')} AS vec FROM cleaned a JOIN mix m ON m.id = a.news_id GROUP BY news_id, Stock", texts=f"SELECT news_id AS id, {tokens_sql(STOPPED)} AS s FROM cleaned", mix=LETTER_MIX_SQL))
def embedding_cache(t: Tables) -> DataFrame:
    rows = written(articles(t, STOPPED).withColumnRenamed("Processed", "Processed_Title"), "articles")
    known = rows.filter(F.col("Stock") < "ASIA").select(F.col("Processed_Title").alias("text")).distinct()
    cache = written(B.embed_texts(known, letter_mix).withColumn("key", B.text_key(F.col("text"))), "cache")
    with_vec, _ = B.embedding_cache(rows, cache, letter_mix)
    return with_vec.select("news_id", "Stock", pack("vec").alias("vec"))
