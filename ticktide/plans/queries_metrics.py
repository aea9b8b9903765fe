"""Queries: evaluation of scored rows, reports and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.operators import metrics as M
from ticktide.operators import panel as P
from ticktide.plans.oracle import with_views
from ticktide.plans.queries_panel import panel_once, scored, scored_once, with_scores
from ticktide.plans.registry import query, r
from ticktide.sources.tables import Tables


def sql_round(x: str, digits: int = 4) -> str:
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


@query("a7_confusion_matrix", with_views("confusion", "SELECT * FROM confusion"))
def confusion_matrix(t: Tables) -> DataFrame:
    return M.confusion_matrix(scored(t))


@query("a8_classification_metrics", with_views("rates", f"""SELECT model, Stock, n_test, {sql_round('accuracy')} AS accuracy, {sql_round('f1_score')} AS f1_score,
  {sql_round('precision_up')} AS precision_up, {sql_round('recall_up')} AS recall_up FROM rates"""))
def classification_metrics(t: Tables) -> DataFrame:
    return M.classification_metrics(scored(t))


@query("a9_roc_auc", with_views("auc", "SELECT model, Stock, round(auc_roc, 9) AS auc_roc FROM auc"))
def roc_auc(t: Tables) -> DataFrame:
    return M.roc_auc(scored(t)).withColumn("auc_roc", r("auc_roc", 9))


@query("a9_roc_auc_all", with_views("scored", """SELECT model, round((sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0) / (sum(y_true) * (count(*) - sum(y_true))), 9) AS auc_roc FROM (
  SELECT model, CAST(y_true AS DOUBLE) AS y_true, rank() OVER (PARTITION BY model ORDER BY y_prob) + (count(*) OVER (PARTITION BY model, y_prob) - 1) / 2.0 AS r FROM scored) GROUP BY model"""))
def roc_auc_all(t: Tables) -> DataFrame:
    """Over all symbols: one group per model, whatever its size."""
    return M.roc_auc(scored(t), ["model"]).withColumn("auc_roc", r("auc_roc", 9))


CURVE = """SELECT *, sum(neg) OVER w AS fps, sum(pos) OVER w AS tps, lead(neg) OVER w AS nneg, lead(pos) OVER w AS npos, row_number() OVER w AS i,
  sum(neg) OVER (PARTITION BY model, Stock) AS n, sum(pos) OVER (PARTITION BY model, Stock) AS p FROM (
  SELECT model, Stock, y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM scored GROUP BY ALL)
  WINDOW w AS (PARTITION BY model, Stock ORDER BY y_prob DESC)"""
POINTS = """SELECT model, Stock, round(CASE WHEN n > 0 THEN fps / n ELSE 0 END, 9) AS fpr, round(CASE WHEN p > 0 THEN tps / p ELSE 0 END, 9) AS tpr, y_prob AS threshold
  FROM curve {where} UNION ALL SELECT DISTINCT model, Stock, 0.0::DOUBLE, 0.0::DOUBLE, 9.0::DOUBLE FROM curve"""


def _curve(points: DataFrame) -> DataFrame:
    shown = F.when(F.col("threshold") == float("inf"), F.lit(9.0)).otherwise(F.col("threshold"))
    return points.select("model", "Stock", r("fpr", 9), r("tpr", 9), shown.alias("threshold"))


@query("a10_roc_curve", with_views("scored", POINTS.format(where="WHERE i = 1 OR nneg IS NULL OR nneg <> neg OR npos <> pos"), curve=CURVE))
def roc_curve(t: Tables) -> DataFrame:
    return _curve(M.roc_curve(scored(t)))


@query("a10_roc_curve_all_points", with_views("scored", POINTS.format(where=""), curve=CURVE))
def roc_curve_all_points(t: Tables) -> DataFrame:
    return _curve(M.roc_curve(scored(t), drop_intermediate=False))


@query("a11_classification_report", with_views("confusion", """SELECT model, Stock, "row", round(p, 9) AS precision, round(rc, 9) AS recall, round(f, 9) AS f1_score, support FROM (
  SELECT model, Stock, 'Down/Flat' AS "row", p0 AS p, r0 AS rc, f0 AS f, s0 AS support FROM c UNION ALL SELECT model, Stock, 'Up', p1, r1, f1, s1 FROM c
  UNION ALL SELECT model, Stock, 'accuracy', (tn + tp) / n, (tn + tp) / n, (tn + tp) / n, n FROM c
  UNION ALL SELECT model, Stock, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM c
  UNION ALL SELECT model, Stock, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM c)""",
  c="""SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f0, tn + fp AS s0,
  coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1, tp + fn AS s1, tn + fp + fn + tp AS n FROM confusion"""))
def classification_report(t: Tables) -> DataFrame:
    rep = M.classification_report(M.confusion_matrix(scored(t)))
    return rep.select("model", "Stock", "row", r("precision", 9), r("recall", 9), r("f1_score", 9), "support")


@query("a12_metric_summary", with_views("report", "SELECT model, round(avg(accuracy), 6) AS avg_accuracy, round(avg(auc_roc), 6) AS avg_auc_roc, count(*) AS n_stocks FROM report GROUP BY model"))
def metric_summary(t: Tables) -> DataFrame:
    return M.metric_summary(M.train_report(scored(t))).select("model", r("avg_accuracy"), r("avg_auc_roc"), "n_stocks")


def scored_parts(t: Tables) -> DataFrame:
    """Scored rows with the split of their day."""
    return with_scores(P.chrono_split(panel_once(t)))


def part_accuracy(rows: DataFrame, part: str, name: str) -> DataFrame:
    cells = M.rates(M.confusion_matrix(rows.filter(F.col("split") == part)))
    return cells.select("model", "Stock", F.col("accuracy").alias(name))


PARTS_SQL = """SELECT s.model, s.Stock, avg(CAST(y_true = CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS INTEGER)) FILTER (split = 'train') AS train_acc,
  avg(CAST(y_true = CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS INTEGER)) FILTER (split = 'val') AS val_acc,
  avg(CAST(y_true = CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS INTEGER)) FILTER (split = 'test') AS test_acc
  FROM scored s JOIN split p ON p.Stock = s.Stock AND p.Target_Date = s.Target_Date GROUP BY s.model, s.Stock"""


@query("a13_overfit_flag", with_views("scored split", f"""SELECT model, Stock, {sql_round('train_acc - val_acc')} AS gap_val, CAST(train_acc - val_acc > 0.10 AS INTEGER) AS over_val,
  {sql_round('train_acc - test_acc')} AS gap_test, CAST(train_acc - test_acc > 0.15 AS INTEGER) AS over_test, CAST(abs(train_acc - test_acc) > 0.10 AS INTEGER) AS over_abs FROM parts""", parts=PARTS_SQL))
def overfit_flag(t: Tables) -> DataFrame:
    rows = scored_parts(t)
    report = part_accuracy(rows, "train", "train_acc")
    for part in ("val", "test"):
        report = report.join(part_accuracy(rows, part, f"{part}_acc"), ["model", "Stock"])
    val = M.overfit_flag(report).withColumnsRenamed({"overfit_gap": "gap_val", "overfit": "over_val"})
    test = M.overfit_flag(val, held_out="test_acc", limit=0.15).withColumnsRenamed({"overfit_gap": "gap_test", "overfit": "over_test"})
    both = M.overfit_flag(test, held_out="test_acc", absolute=True).withColumnRenamed("overfit", "over_abs")
    return both.select("model", "Stock", "gap_val", "over_val", "gap_test", "over_test", "over_abs")


@query("a14_best_epoch", with_views("feed", f"""SELECT Stock, best.epoch AS best_epoch, n AS total_epochs, {sql_round('best.accuracy')} AS train_acc, {sql_round('best.val_accuracy')} AS val_acc
  FROM (SELECT Stock, count(*) AS n, arg_min({{'epoch': epoch, 'accuracy': accuracy, 'val_accuracy': val_accuracy}}, row(val_loss, epoch)) AS best FROM wide GROUP BY Stock)""",
  wide="""SELECT Stock, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 0) AS val_loss, avg(CAST(event_type = 'click' AS INTEGER)) AS accuracy,
  avg(CAST(event_type = 'view' AS INTEGER)) AS val_accuracy FROM feed GROUP BY ALL"""))
def best_epoch(t: Tables) -> DataFrame:
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    per_day = t.feed().groupBy("Stock", F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value"), 0).alias("val_loss"), share("click").alias("accuracy"), share("view").alias("val_accuracy")
    )
    history = per_day.unpivot(["Stock", "epoch"], ["val_loss", "accuracy", "val_accuracy"], "metric", "value")
    return M.best_epoch(history)


@query("m13_train_report", with_views("rates auc scored split", f"""SELECT r.model, r.Stock, n_test, {sql_round('accuracy')} AS accuracy, {sql_round('f1_score')} AS f1_score, {sql_round('auc_roc')} AS auc_roc,
  {sql_round('precision_up')} AS precision_up, {sql_round('recall_up')} AS recall_up, tn || ' ' || fp || ' ' || fn || ' ' || tp AS confusion, {sql_round('train_acc')} AS train_acc, {sql_round('train_acc - accuracy')} AS overfit_gap
  FROM rates r JOIN auc a ON a.model = r.model AND a.Stock = r.Stock JOIN parts p ON p.model = r.model AND p.Stock = r.Stock""", parts=PARTS_SQL))
def train_report(t: Tables) -> DataFrame:
    rows = scored_parts(t)
    report = M.train_report(rows, fitted=part_accuracy(rows, "train", "train_acc"))
    flat = F.array_join(F.flatten("confusion_matrix").cast("array<string>"), " ")
    return report.withColumn("confusion", flat).drop("confusion_matrix")


# ---- two reports against each other --------------------------------------------------


def two_reports(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two reports that SQL can make as well: all score tables, and each model's scores under the name of the next.

    ``j6_compare_models`` compares trained models.
    """
    report = M.train_report(scored_once(t))
    turned = F.create_map(F.lit("lstm"), F.lit("rf"), F.lit("rf"), F.lit("svm"), F.lit("svm"), F.lit("gru"))
    return report, report.withColumn("model", turned[F.col("model")])


TWO_SQL = {
    "tfidf": "SELECT * FROM report",
    "dense": "SELECT * REPLACE (CASE model WHEN 'lstm' THEN 'rf' WHEN 'rf' THEN 'svm' ELSE 'gru' END AS model) FROM report",
}


@query("j6_compare_reports", with_views("report", """SELECT t.model, t.Stock, t.auc_roc AS tfidf, d.auc_roc AS embedding, round(t.auc_roc - d.auc_roc, 6) AS diff,
  CASE WHEN d.auc_roc IS NULL THEN 'N/A' WHEN t.auc_roc - d.auc_roc > 0.01 THEN 'TF-IDF' WHEN t.auc_roc - d.auc_roc < -0.01 THEN 'embedding' ELSE 'tie' END AS winner
  FROM tfidf t LEFT JOIN dense d ON d.model = t.model AND d.Stock = t.Stock""", **TWO_SQL))
def compare_reports(t: Tables) -> DataFrame:
    return M.compare_reports(*two_reports(t)).withColumn("diff", r("diff"))


@query("j6_compare_chart", with_views("report", """SELECT t.model, t.Stock, t.accuracy AS accuracy_tfidf, coalesce(d.accuracy, 0) AS accuracy_dense, t.auc_roc AS auc_roc_tfidf, coalesce(d.auc_roc, 0) AS auc_roc_dense,
  t.f1_score AS f1_score_tfidf, coalesce(d.f1_score, 0) AS f1_score_dense FROM tfidf t LEFT JOIN dense d ON d.model = t.model AND d.Stock = t.Stock
  WHERE d.Stock IS NOT NULL OR NOT EXISTS (SELECT 1 FROM tfidf a JOIN dense b ON a.model = b.model AND a.Stock = b.Stock WHERE a.model = t.model)""", **TWO_SQL))
def compare_chart(t: Tables) -> DataFrame:
    return M.compare_chart(*two_reports(t))
