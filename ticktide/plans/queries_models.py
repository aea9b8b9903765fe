"""Queries: model features, fits, validation, the daily job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.operators import embedding_quality as E
from ticktide.operators import metrics as M
from ticktide.operators import models as L
from ticktide.operators import margins, recurrent, trees
from ticktide.operators import panel as P
from ticktide.operators import tfidf as T
from ticktide.plans.dataset import modelling_panel
from ticktide.plans.queries_panel import panel, panel_once
from ticktide.plans.queries_quality import POINTS, quality, row_key
from ticktide.plans.queries_text import articles_once, train_part
from ticktide.plans.registry import pack, query, r
from ticktide.plans.scoring import daily_scoring_job
from ticktide.session import written
from ticktide.sources.tables import Tables

REPORT = ("model", "Stock", "n_test", "accuracy", "f1_score", "auc_roc", "precision_up", "recall_up", "train_acc", "val_acc", "overfit_gap")


def gated_panel(t: Tables, minimum: int = 60) -> DataFrame:
    return P.enough_rows(written(panel(t)), minimum)


def gated_parts(t: Tables) -> DataFrame:
    """Scaled rows of the symbols with enough of them; the fit and the projection both read them."""
    return written(L.scaled_parts(gated_panel(t)))


@query("m2_pca_reduce")
def pca_reduce(t: Tables) -> DataFrame:
    reduced = L.pca_reduce(gated_parts(t), variance=0.90, train=F.expr(L.IN_TRAIN))
    return reduced.rows.select("Stock", "Target_Date", "split", F.size("vec").alias("components"), pack(F.transform("vec", F.abs)).alias("vec"))


@query("m3_pca_variance_curve")
def pca_variance_curve(t: Tables) -> DataFrame:
    reduced = L.pca_reduce(gated_parts(t), variance=0.95, train=F.expr(L.IN_TRAIN))
    return L.variance_curve(reduced.variance).select("Stock", "component", r("ratio"), r("cumulative"))


@query("m4_random_forest")
def random_forest(t: Tables) -> DataFrame:
    ready, _ = L.forest_features(gated_panel(t))
    return L.evaluate(L.score_forest(ready, L.fit_forest(ready))).select(*REPORT)


@query("m4_archive_forest")
def archive_forest(t: Tables) -> DataFrame:
    """Deeper trees on the scaled vector and prices as they are, fitted on train and validation rows."""
    ready = L.plain_features(gated_panel(t), prices=True)
    fitted = L.fit_forest(ready, 300, L.DEEP_FOREST, "split <> 'test'", sample=1.0)
    return L.evaluate(L.score_forest(ready, fitted)).select(*REPORT)


@query("d7_top_k_features")
def top_k_features(t: Tables) -> DataFrame:
    ready, reduced = L.forest_features(gated_panel(t))
    found = trees.named(trees.importances(L.fit_forest(ready)), reduced.components, P.PRICE_COLUMNS)
    return L.top_k_features(found).select("Stock", "place", "feature", r("importance"), "is_price")


@query("m5_svm_grid_search")
def svm_grid_search(t: Tables) -> DataFrame:
    ready, _ = L.margin_features(gated_panel(t, 80))
    scored, best = margins.grid_search(ready)
    return L.evaluate(scored).join(best, "Stock").select(*REPORT, "best_C", "best_gamma", "best_cv_auc")


@query("m8_cross_validate")
def cross_validate(t: Tables) -> DataFrame:
    ready, _ = L.forest_features(gated_panel(t))
    folded = M.stratified_folds(ready.filter("split <> 'test'"), F.col("Target_Date"))
    return L.cross_validate_forest(folded).select("Stock", r("cv_auc_mean", 4), r("cv_auc_std", 4))


@query("m9_gradient_boosting")
def gradient_boosting(t: Tables) -> DataFrame:
    ready = L.plain_features(gated_panel(t, 80), L.up_weighted)
    fitted = L.fit_boosting(ready)
    rounds = fitted.groupBy("Stock").agg(F.count("*").cast("int").alias("best_round"))
    return L.evaluate(L.score_forest(ready, fitted, "xgboost", boosted=True)).join(rounds, "Stock").select(*REPORT, "best_round")


def sequences(t: Tables) -> DataFrame:
    """The features of the row before each day (a sequence of length one), class-weighted."""
    ready, _ = L.forest_features(gated_panel(t))
    before = P.sliding_sequences(ready.drop("split"), "x", window=1)
    return written(L.weighted(before, F.expr(L.IN_TRAIN)).select(
        "Stock", "Target_Date", "split", L.LABEL, "weight", F.col(L.LABEL).cast("double").alias("label"), F.flatten("sequence").alias("x")
    ), "sequences")


@query("m10_neural_classifier")
def neural_classifier(t: Tables) -> DataFrame:
    seq = sequences(t)
    nets = written(recurrent.fit(seq), "nets")
    best = M.best_epoch(recurrent.history(nets)).select("Stock", "best_epoch", "total_epochs")
    return L.evaluate(recurrent.score(seq, nets, L.KEEP)).join(best, "Stock").select(*REPORT, "best_epoch", "total_epochs")


@query("a14_training_history")
def training_history(t: Tables) -> DataFrame:
    """The best epoch of every net's own history."""
    return M.best_epoch(recurrent.history(written(recurrent.fit(sequences(t)), "nets")))


def kernel_report(scored: DataFrame) -> DataFrame:
    return L.evaluate(scored).select("model", "Stock", "accuracy", "f1_score", "auc_roc")


def two_kinds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Reports of forest and kernel margins on daily TF-IDF vectors and on daily mean vectors, prices beside both."""
    words = articles_once(t)
    prices = t.once("prices", t.prices)
    vocabulary = written(T.tfidf_fit(train_part(words)), "vocabulary")
    sparse = T.tfidf_panel(words, P.label_open_direction(prices), vocabulary)
    tfidf = P.enough_rows(written(T.dense_terms(sparse, vocabulary), "tfidf_panel"), 80)
    # the articles are the news that is kept, on the days that it aims at
    kept = words.select("news_id", "Stock", F.col("Target_Date").alias("Date"))
    dense = P.enough_rows(written(modelling_panel(kept, t.doc_vec(), prices, shift_days=0, unique=True)), 80)
    plain = L.plain_features(tfidf, prices=True)
    deep = L.fit_forest(plain, 300, L.DEEP_FOREST, "split <> 'test'", sample=1.0)
    ready, _ = L.forest_features(dense)
    # more terms than train days: components by rows
    wide, _ = L.margin_features(tfidf, by_rows=True)
    narrow, _ = L.margin_features(dense)
    of_terms = kernel_report(L.score_forest(plain, deep)).unionByName(kernel_report(margins.grid_search(wide)[0]))
    of_vectors = kernel_report(L.score_forest(ready, L.fit_forest(ready))).unionByName(kernel_report(margins.grid_search(narrow)[0]))
    return written(of_terms, "tfidf_report"), written(of_vectors, "vector_report")


@query("j6_compare_models")
def compare_models(t: Tables) -> DataFrame:
    return M.compare_reports(*two_kinds(t)).withColumn("diff", r("diff"))


def logistic_models(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ready = L.plain_features(rows)
    return ready, written(L.fit_logistics(ready), "logistics")


@query("m11_score_batch")
def score_batch(t: Tables) -> DataFrame:
    ready, fits = logistic_models(gated_panel(t))
    return L.score_weights(ready, fits, "logreg").select("Stock", "Target_Date", "split", "model", r("y_prob"))


@query("e7_linear_probe")
def linear_probe(t: Tables) -> DataFrame:
    rows = written(E.rows_enough(E.with_all(panel(t).select("Stock", "Target_Date", L.LABEL, "vec", row_key().alias("key")))))
    return L.linear_probe(rows, E.shuffled(F.col("key"), 42))


def probed(t: Tables) -> DataFrame:
    """Panel rows under their symbol and under ALL, with a unique key."""
    return written(E.with_all(panel_once(t).select("Stock", "Target_Date", L.LABEL, "vec", row_key().alias("key"))), "groups")


@query("e8_knn_probe")
def knn_probe(t: Tables) -> DataFrame:
    """On vectors scaled and reduced per group, as the linear probe has them."""
    folded, _ = L.probe_folds(E.rows_enough(probed(t)), E.shuffled(F.col("key"), 42))
    return E.knn_accuracy(E.knn_vote(folded, label=L.LABEL, group="Stock")).select(F.col("grp").alias("Stock"), r("knn_acc"))


@query("e9_score_card")
def score_card(t: Tables) -> DataFrame:
    found = L.separability(probed(t), E.shuffled(F.col("key"), 42)).select("Stock", "logreg_auc", "silhouette")
    return E.score_card(quality(t).join(found, "Stock", "left")).select("Stock", *POINTS)


@query("e10_per_stock_separability")
def per_stock_separability(t: Tables) -> DataFrame:
    return L.separability(probed(t), E.shuffled(F.col("key"), 42))


@query("x5_daily_scoring_job")
def daily_scoring(t: Tables) -> DataFrame:
    rows = gated_panel(t)
    ready, fits = logistic_models(rows)
    report = L.evaluate(L.score_weights(ready, fits, "logreg")).withColumn("model_rank", F.lit(0))
    sound = lambda df: df.withColumn("vec", L.V.nan_to_num(F.col("vec")))  # noqa: E731  as in training
    fitted = L.S.vector_stats(P.chrono_split(sound(rows)).filter(L.IN_TRAIN), ["Stock"], "vec")

    def score(pooled: DataFrame) -> DataFrame:
        scaled = sound(pooled).join(fitted, "Stock").withColumn("x", L.S.apply_scale(F.col("vec"), F.col("mean"), F.col("std")))
        return L.score_weights(scaled, fits, "logreg", keep=())

    feed = t.news().select(
        "Stock", "news_id", "Date", F.col("Title").alias("headline"), F.col("Source").alias("source"),
        F.col("Link").alias("link"),
    ).withColumnRenamed("Date", "day").withColumn("date", F.col("day").cast("string"))
    snap = daily_scoring_job(
        t.symbols(), feed, t.doc_vec(), score, report, F.lit("1995-11-06"), [F.desc("day"), F.asc("news_id")]
    )
    p = F.col("prediction")
    return snap.select("Stock", "date", p["news_count"].alias("news_count"), p["recommended"]["model"].alias("model"),
                       p["recommended"]["label"].alias("label"), r(p["recommended"]["probability_up"]).alias("probability_up"))
