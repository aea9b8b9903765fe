"""Facts of fitted models that any engine can know: sizes, ranges, norms and what leaves out short groups.

Their values come from fits, so SQL can't repeat them; these queries run the same fits and return what must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.operators import models as L
from ticktide.plans import queries_models as Q
from ticktide.plans.oracle import with_views
from ticktide.plans.queries_metrics import sql_round
from ticktide.plans.queries_quality import DRAWN, L2, PAIRS, SCALED, SHAPES
from ticktide.plans.registry import query, r
from ticktide.sources.tables import Tables

GATED = "SELECT Stock FROM split GROUP BY Stock HAVING count(*) >= {minimum} AND count(DISTINCT Target_Label) FILTER (split = 'train') = 2"
SIZES = """SELECT Stock, CAST(count(*) FILTER (split = 'test') AS BIGINT) AS n_test, 1 AS sound FROM split
  WHERE Stock IN (SELECT Stock FROM gated) GROUP BY Stock"""


def between(*columns: str | Column) -> Column:
    """Whether all of them are chances."""
    sound = F.lit(True)
    for c in columns:
        column = F.col(c) if isinstance(c, str) else c
        sound = sound & column.between(0.0, 1.0)
    return sound


def report_facts(report: DataFrame, *more: Column) -> DataFrame:
    """Test rows, and whether every measure is a share and the accuracy a number of them."""
    hits = F.col("accuracy") * F.col("n_test")
    sound = between("accuracy", "f1_score", "auc_roc", "precision_up", "recall_up", "train_acc", "val_acc")
    sound = sound & (F.abs(hits - F.round(hits)) <= F.col("n_test") * 1e-4)
    for column in more:
        sound = sound & column
    return report.select("Stock", F.col("n_test").cast("long").alias("n_test"), sound.cast("int").alias("sound"))


def facts_of(name: str, minimum: int = 60):
    return query(name, with_views("split", SIZES, gated=GATED.format(minimum=minimum)))


@facts_of("m4_random_forest_facts")
def random_forest(t: Tables) -> DataFrame:
    return report_facts(Q.random_forest(t))


@facts_of("m4_archive_forest_facts")
def archive_forest(t: Tables) -> DataFrame:
    return report_facts(Q.archive_forest(t))


@facts_of("m5_svm_grid_search_facts", 80)
def svm_grid_search(t: Tables) -> DataFrame:
    return report_facts(Q.svm_grid_search(t), between("best_cv_auc"), F.col("best_C").isin(*Q.margins.GRID), F.col("best_gamma").isin(*map(str, Q.margins.GAMMAS)))


@facts_of("m9_gradient_boosting_facts", 80)
def gradient_boosting(t: Tables) -> DataFrame:
    return report_facts(Q.gradient_boosting(t), F.col("best_round").between(1, Q.trees.Boosting().rounds))


@facts_of("m10_neural_classifier_facts")
def neural_classifier(t: Tables) -> DataFrame:
    return report_facts(Q.neural_classifier(t), F.col("best_epoch") <= F.col("total_epochs"))


@query("m2_pca_full_rank", with_views("split cells", """SELECT Stock, CAST(Target_Date AS VARCHAR) AS Target_Date, split, round(sum(z * z), 5) AS squares FROM (
  SELECT Stock, Target_Date, split, (m - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM (
  SELECT s.Stock, s.Target_Date, s.split, c.pos, c.m, avg(c.m) FILTER (s.split = 'train') OVER (PARTITION BY s.Stock, c.pos) AS mu,
    stddev_pop(c.m) FILTER (s.split = 'train') OVER (PARTITION BY s.Stock, c.pos) AS sd
  FROM split s JOIN cells c ON c.Stock = s.Stock AND c.Target_Date = s.Target_Date WHERE s.n_rows >= 60)) GROUP BY Stock, Target_Date, split"""))
def pca_full_rank(t: Tables) -> DataFrame:
    """All components together keep every row's squared norm."""
    rows = L.pca_reduce(Q.gated_parts(t), variance=1.0, train=F.expr(L.IN_TRAIN)).rows
    return rows.select("Stock", "Target_Date", "split", r(L.V.dot(F.col("vec"), F.col("vec")), 5).alias("squares"))


@query("m3_pca_variance_facts", with_views("split cells", """SELECT Stock, (SELECT count(DISTINCT pos) FROM cells) AS components, CAST(1 AS DOUBLE) AS last, 1 AS falls
  FROM split GROUP BY Stock HAVING count(*) >= 60"""))
def pca_variance(t: Tables) -> DataFrame:
    """The curve has a point per dimension, its steps fall and it ends at 1."""
    curve = Q.pca_variance_curve(t)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("component", "ratio"))), lambda s: s["ratio"])
    falls = (F.array_sort(steps, lambda a, b: F.signum(b - a).cast("int")) == steps).cast("int")
    return curve.groupBy("Stock").agg(F.count("*").alias("components"), r(F.max("cumulative"), 5).alias("last"), falls.alias("falls"))


@query("m8_cross_validate_facts", with_views("split", "SELECT Stock, 1 AS sound FROM gated", gated=GATED.format(minimum=60)))
def cross_validate(t: Tables) -> DataFrame:
    return Q.cross_validate(t).select("Stock", (between("cv_auc_mean") & F.col("cv_auc_std").between(0.0, 0.5)).cast("int").alias("sound"))


@query("d7_top_k_features_facts", with_views("split", "SELECT Stock, 1 AS sound FROM gated", gated=GATED.format(minimum=60)))
def top_k_features(t: Tables) -> DataFrame:
    """At most twenty different features a symbol, numbered from 1 in falling order, with shares that add up to 1 at most."""
    top = Q.top_k_features(t).groupBy("Stock").agg(
        F.count("*").alias("n"), F.max("place").alias("last"), F.countDistinct("feature").alias("names"), F.sum("importance").alias("total"),
        F.array_sort(F.collect_list(F.struct("place", (-F.col("importance")).alias("i")))).alias("ranked"),
    )
    down = F.transform("ranked", lambda x: x["i"])
    sound = (F.col("n") <= 20) & (F.col("last") == F.col("n")) & (F.col("names") == F.col("n")) & (F.col("total") <= 1.00002) & (F.array_sort(down) == down)
    return top.select("Stock", sound.cast("int").alias("sound"))


@query("m11_score_batch_facts", with_views("split", """SELECT Stock, split, count(*) AS n, 1 AS sound FROM split WHERE Stock IN (SELECT Stock FROM gated)
  GROUP BY Stock, split""", gated=GATED.format(minimum=60)))
def score_batch(t: Tables) -> DataFrame:
    return Q.score_batch(t).groupBy("Stock", "split").agg(F.count("*").alias("n"), F.min(between("y_prob").cast("int")).alias("sound"))


GROUPS = "SELECT grp AS Stock, 1 AS sound FROM both_groups GROUP BY grp HAVING count(*) >= 20 AND count(DISTINCT Target_Label) = 2"


@query("e7_linear_probe_facts", with_views("both_groups", GROUPS))
def linear_probe(t: Tables) -> DataFrame:
    sound = between("logreg_acc", "logreg_auc", "pca_variance_explained") & F.col("logreg_acc_std").between(0.0, 0.5)
    return Q.linear_probe(t).select("Stock", sound.cast("int").alias("sound"))


@query("e8_knn_probe_facts", with_views("both_groups", GROUPS))
def knn_probe(t: Tables) -> DataFrame:
    return Q.knn_probe(t).select("Stock", between("knn_acc").cast("int").alias("sound"))


@query("e9_score_card_facts", with_views("both_groups", f"""SELECT l2.Stock, {sql_round(f"least(coalesce({sql_round('inter_l2 / ((intra_l2_down + intra_l2_up) / 2)')}, 1.0) / 2, 1) * 25", 1)} AS separability_index,
  {sql_round(f"(1 - {sql_round('ani')}) * 15", 1)} AS anisotropy_penalty, {sql_round(f"({sql_round('silhouette')} + 1) / 2 * 25", 1)} AS silhouette_points, 1 AS sound
  FROM l2 JOIN (SELECT grp, avg(c) AS ani FROM pairs WHERE ka < kb GROUP BY grp) p ON p.grp = l2.Stock JOIN shapes ON shapes.grp = l2.Stock
  JOIN (SELECT grp FROM both_groups GROUP BY grp HAVING count(*) >= 20 AND count(DISTINCT Target_Label) = 2) g ON g.grp = l2.Stock""",
  pairs=PAIRS, drawn=DRAWN, l2=L2, scaled=SCALED, shapes=SHAPES))
def score_card(t: Tables) -> DataFrame:
    """All points but the probe's are known; the probe's lie between 0 and 35, and the score is their sum."""
    card = Q.score_card(t)
    parts = F.col("separability_index") + F.col("linear_probe_auc") + F.col("silhouette_points") + F.col("anisotropy_penalty")
    sound = F.col("linear_probe_auc").between(0.0, 35.0) & (F.abs(parts - F.col("overall_score")) < 0.25)
    found = L.groups_fit(Q.probed(t)).filter("fit").select("Stock")
    return card.join(found, "Stock", "left_semi").select("Stock", "separability_index", "anisotropy_penalty", "silhouette_points", sound.cast("int").alias("sound"))


@query("e10_per_stock_separability_facts", with_views("both_groups", """SELECT grp AS Stock, CAST(count(*) >= 20 AND count(DISTINCT Target_Label) = 2 AS INTEGER) AS fitted, 1 AS sound
  FROM both_groups GROUP BY grp"""))
def separability(t: Tables) -> DataFrame:
    """Groups that are too small or of one class keep a row of NULLs."""
    found = Q.per_stock_separability(t)
    values = ["logreg_acc", "logreg_auc", "pca_variance_explained", "knn_acc"]
    all_there, none_there = F.lit(True), F.lit(True)
    for c in (*values, "logreg_acc_std", "silhouette"):
        all_there, none_there = all_there & F.col(c).isNotNull(), none_there & F.col(c).isNull()
    sound = none_there | (all_there & between(*values) & F.col("silhouette").between(-1.0, 1.0))
    return found.select("Stock", all_there.cast("int").alias("fitted"), sound.cast("int").alias("sound"))


@query("x5_daily_scoring_facts", with_views("symbols news split", """SELECT s.Stock, CAST(n.n AS INTEGER) AS news_count, CAST(g.Stock IS NOT NULL AND n.n IS NOT NULL AS INTEGER) AS scored, 1 AS sound
  FROM symbols s LEFT JOIN (SELECT Stock, least(count(*), 10) AS n FROM news GROUP BY Stock) n ON n.Stock = s.Stock LEFT JOIN gated g ON g.Stock = s.Stock""",
  gated=GATED.format(minimum=60)))
def daily_scoring(t: Tables) -> DataFrame:
    found = Q.daily_scoring(t)
    p = F.col("probability_up")
    right = p.isNull() | (p.between(0.0, 1.0) & (F.col("label") == F.when(p >= 0.5, "Up").otherwise("Down")))
    return found.select("Stock", "news_count", p.isNotNull().cast("int").alias("scored"), right.cast("int").alias("sound"))
