"""Classifier evaluation as grouped aggregates over (group, y_true, y_prob) rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.display import half_even
from ticktide.operators.ordered import COARSE, FINE, running_totals, score_ranges
from ticktide.operators.panel import join_spread

GROUP = ("model", "Stock")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# ---- class balance ------------------------------------------------------------------

def up_ratio(panel: DataFrame, label: str = "Target_Label", stock: str = "Stock") -> DataFrame:
    """Share of Up days in the train part (expects ``split``)."""
    train = panel.filter(F.col("split") == "train")
    return train.groupBy(stock).agg(F.avg(label).alias("up_ratio"), F.count(label).alias("n_train"))


def class_weights(train: DataFrame, label: str = "Target_Label", stock: str = "Stock") -> DataFrame:
    """Balanced weights n / (k * n_c); symbols with a single class drop out."""
    counts = train.groupBy(stock).agg(
        F.count(label).alias("n"), _count(F.col(label) == 0).alias("n0"), _count(F.col(label) == 1).alias("n1")
    ).filter((F.col("n0") > 0) & (F.col("n1") > 0))
    return counts.select(
        stock,
        (F.col("n") / (F.col("n0") * 2.0)).alias("weight_0"),
        (F.col("n") / (F.col("n1") * 2.0)).alias("weight_1"),
    )


def scale_pos_weight(train: DataFrame, label: str = "Target_Label", stock: str = "Stock") -> DataFrame:
    n0, n1 = _count(F.col(label) == 0), _count(F.col(label) == 1)
    return train.groupBy(stock).agg(
        F.when(n1 == 0, F.lit(1.0)).otherwise(half_even(n0 / n1)).alias("scale_pos_weight")
    )


# ---- confusion and what follows from it ---------------------------------------------

def confusion_matrix(scored: DataFrame, group: Sequence[str] = GROUP, threshold: float = 0.5) -> DataFrame:
    hit = (F.col("y_prob") >= threshold).cast("int")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return scored.groupBy(*group).agg(
        *[_count((F.col("y_true") == t) & (hit == p)).alias(name) for name, (t, p) in cells.items()]
    )


def rates(confusion: DataFrame) -> DataFrame:
    """Unrounded accuracy, precision, recall and F1 from the four cells; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        confusion.withColumn("n_test", tn + fp + fn + tp)
        .withColumn("accuracy", _ratio(tp + tn, F.col("n_test")))
        .withColumn("precision_up", _ratio(tp, tp + fp))
        .withColumn("recall_up", _ratio(tp, tp + fn))
        .withColumn("f1_score", _ratio(tp * 2.0, tp * 2 + fp + fn))
    )


def classification_metrics(scored: DataFrame, group: Sequence[str] = GROUP, threshold: float = 0.5) -> DataFrame:
    r = rates(confusion_matrix(scored, group, threshold))
    return r.select(
        *group, "n_test", *[half_even(F.col(c)).alias(c) for c in ("accuracy", "f1_score", "precision_up", "recall_up")]
    )


def classification_report(confusion: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Precision, recall, F1, support per class, plus accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def cls(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(hit * 2.0, hit * 2 + wrong + missed).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    down, up = cls("Down/Flat", tn, fn, fp), cls("Up", tp, fp, fn)
    two = confusion.withColumn("_d", down).withColumn("_u", up).withColumn("_n", tn + fp + fn + tp)
    names = ("precision", "recall", "f1_score")
    accuracy = _ratio(tp + tn, F.col("_n"))

    def row(name: str, values: Sequence[Column]) -> Column:
        return F.struct(F.lit(name).alias("row"), *[v.alias(c) for v, c in zip(values, names)], F.col("_n").alias("support"))

    macro = [(F.col(f"_d.{c}") + F.col(f"_u.{c}")) / 2.0 for c in names]
    weighted = [
        _ratio(F.col(f"_d.{c}") * F.col("_d.support") + F.col(f"_u.{c}") * F.col("_u.support"), F.col("_n")) for c in names
    ]
    rows = F.array("_d", "_u", row("accuracy", [accuracy] * 3), row("macro avg", macro), row("weighted avg", weighted))
    return two.select(*group, F.inline(rows))


# ---- ranking ------------------------------------------------------------------------

def score_counts(scored: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """One row per group and distinct score; equal scores merge before the shuffle."""
    return scored.groupBy(*group, "y_prob").agg(
        _count(F.col("y_true") == 1).alias("pos"), _count(F.col("y_true") == 0).alias("neg")
    )


def roc_auc(scored: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Area under the ROC curve with ties counted half; 0.5 when a class is missing."""
    counts = score_counts(scored, group)
    below = running_totals(counts, group, "y_prob", ["neg"], score_ranges(F.col("y_prob")))
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*group).agg(F.when(pairs > 0, won / pairs).otherwise(F.lit(0.5)).alias("auc_roc"))


def roc_curve(scored: DataFrame, group: Sequence[str] = GROUP, drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) from the highest score down, starting at (0, 0, infinity).

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    group = list(group)
    counts = score_counts(scored, group)
    above = running_totals(counts, group, "y_prob", ["pos", "neg"], score_ranges(F.col("y_prob")), descending=True)
    if drop_intermediate:
        above = _bends(above, group)
    points = above.select(
        *group,
        (F.col("neg_before") + F.col("neg")).alias("fps"),
        (F.col("pos_before") + F.col("pos")).alias("tps"),
        F.col("y_prob").alias("threshold"),
    )
    totals = counts.groupBy(*group).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    start = totals.select(*group, F.lit(0).alias("fps"), F.lit(0).alias("tps"), F.lit(float("inf")).alias("threshold"))
    return (
        points.unionByName(start)
        .join(totals, group)
        .select(*group, _ratio(F.col("fps"), F.col("_n")).alias("fpr"), _ratio(F.col("tps"), F.col("_p")).alias("tpr"), "threshold")
    )


def _bends(counts: DataFrame, group: list[str]) -> DataFrame:
    """Keep the first and last point and those where the step to the next differs from the step here."""
    coarse, fine = score_ranges(F.col("y_prob"))
    rows = counts.withColumn(COARSE, coarse).withColumn(FINE, fine)
    step = F.struct(F.col("pos").alias("p"), F.col("neg").alias("n"))
    w = Window.partitionBy(*group, COARSE, FINE).orderBy(F.desc("y_prob"))
    local = rows.select("*", F.lead(step).over(w).alias("_next"), F.row_number().over(w).alias("_first"))
    # the first step of each range, handed to the range above it
    heads = rows.groupBy(*group, COARSE, FINE).agg(F.max_by(step, "y_prob").alias("_head"))
    edge = heads.groupBy(*group, COARSE).agg(F.max_by("_head", FINE).alias("_head"))
    w_fine = Window.partitionBy(*group, COARSE).orderBy(F.desc(FINE))
    w_coarse = Window.partitionBy(*group).orderBy(F.desc(COARSE))
    after = edge.select(*group, COARSE, F.lead("_head").over(w_coarse).alias("_after"), F.row_number().over(w_coarse).alias("_rank_c"))
    links = heads.select(*group, COARSE, FINE, F.lead("_head").over(w_fine).alias("_over"), F.row_number().over(w_fine).alias("_rank_f")).join(
        after, [*group, COARSE]
    )
    joined = local.join(links, [*group, COARSE, FINE])
    following = F.coalesce("_next", "_over", "_after")
    is_first = (F.col("_first") == 1) & (F.col("_rank_f") == 1) & (F.col("_rank_c") == 1)
    return joined.filter(is_first | following.isNull() | (following != step)).select(*counts.columns)


# ---- summaries ----------------------------------------------------------------------

def metric_summary(report: DataFrame, metrics: Sequence[str] = ("accuracy", "auc_roc"), model: str = "model") -> DataFrame:
    return report.groupBy(model).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in metrics], F.count(F.lit(1)).alias("n_stocks")
    )


def overfit_flag(
    report: DataFrame, fitted: str = "train_acc", held_out: str = "val_acc", limit: float = 0.10, absolute: bool = False
) -> DataFrame:
    gap = F.col(fitted) - F.col(held_out)
    over = (F.abs(gap) if absolute else gap) > limit
    return report.withColumn("overfit_gap", half_even(gap)).withColumn("overfit", over)


def best_epoch(history: DataFrame, group: Sequence[str] = ("Stock",), monitor: str = "val_loss") -> DataFrame:
    """Per group the epoch (1-based) of the lowest monitored value, the first on a tie.

    ``history`` is long: group, metric, epoch, value.
    """
    wide = history.groupBy(*group, "epoch").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in dict.fromkeys((monitor, "accuracy", "val_accuracy"))]
    )
    best = F.min_by(F.struct("epoch", "accuracy", "val_accuracy"), F.struct(monitor, "epoch"))
    return wide.groupBy(*group).agg(best.alias("_b"), F.count("epoch").alias("total_epochs")).select(
        *group,
        F.col("_b.epoch").alias("best_epoch"),
        "total_epochs",
        half_even(F.col("_b.accuracy")).alias("train_acc"),
        half_even(F.col("_b.val_accuracy")).alias("val_acc"),
    )


def train_report(scored: DataFrame, group: Sequence[str] = GROUP, fitted: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row of metrics per group; ``fitted`` adds train_acc and the overfit gap."""
    cells = confusion_matrix(scored, group, threshold)
    base = rates(cells).join(roc_auc(scored, group), list(group))
    rounded = [half_even(F.col(c)).alias(c) for c in ("accuracy", "f1_score", "auc_roc", "precision_up", "recall_up")]
    cm = F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix")
    if fitted is None:
        return base.select(*group, "n_test", *rounded, cm)
    both = base.join(fitted, list(group))
    return both.select(*group, "n_test", *rounded, cm, half_even(F.col("train_acc")).alias("train_acc"),
                       half_even(F.col("train_acc") - F.col("accuracy")).alias("overfit_gap"))


def compare_reports(tfidf: DataFrame, dense: DataFrame, margin: float = 0.01, metric: str = "auc_roc") -> DataFrame:
    """TF-IDF against embedding results per model and symbol; rows without TF-IDF drop out."""
    left = tfidf.select("model", "Stock", F.col(metric).alias("tfidf")).filter(F.col("tfidf").isNotNull())
    right = dense.select("model", "Stock", F.col(metric).alias("embedding"))
    diff = F.col("tfidf") - F.col("embedding")
    return left.join(right, ["model", "Stock"], "left").select(
        "model", "Stock", "tfidf", "embedding", diff.alias("diff"),
        F.when(diff.isNull(), "N/A").when(diff > margin, "TF-IDF").when(diff < -margin, "embedding").otherwise("tie").alias("winner"),
    )


def compare_chart(tfidf: DataFrame, dense: DataFrame, metrics: Sequence[str] = ("accuracy", "auc_roc", "f1_score")) -> DataFrame:
    """Chart rows: per model the symbols both sides have, or all TF-IDF ones when none is shared."""
    keys = ["model", "Stock"]
    left = tfidf.select(*keys, *[F.col(m).alias(f"{m}_tfidf") for m in metrics])
    right = dense.select(*keys, *[F.col(m).alias(f"{m}_dense") for m in metrics], F.lit(True).alias("_has"))
    both = left.join(right, keys, "left")
    shared = both.groupBy("model").agg(F.count("_has").alias("_shared"))
    return (
        both.join(shared, "model")
        .filter(F.col("_has").isNotNull() | (F.col("_shared") == 0))
        .select(*keys, *[F.coalesce(f"{m}_{side}", F.lit(0.0)).alias(f"{m}_{side}") for m in metrics for side in ("tfidf", "dense")])
    )


def pick_best_model(reports: DataFrame, results: DataFrame, symbols: DataFrame, default: str = "lstm", rank: str = "model_rank") -> DataFrame:
    """Per symbol the model of highest AUC (the first on a tie) and its result, if it has one."""
    best = reports.groupBy("Stock").agg(F.min_by("model", F.struct(-F.col("auc_roc"), F.col(rank))).alias("model"))
    chosen = symbols.select("Stock").join(best, "Stock", "left").withColumn("model", F.coalesce("model", F.lit(default)))
    return chosen.join(results, ["Stock", "model"], "left")


# ---- folds --------------------------------------------------------------------------

def time_series_folds(panel: DataFrame, folds: int = 5, stock: str = "Stock", date: str = "Target_Date") -> DataFrame:
    """Each row once per fold it belongs to: fold i tests the next n // (folds + 1) rows after its train rows."""
    w = Window.partitionBy(stock)
    numbered = (
        panel.withColumn("_i", F.row_number().over(w.orderBy(date)) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(w).cast("int"))
        .withColumn("_size", F.floor(F.col("_n") / (folds + 1)).cast("int"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    )
    start = F.col("_n") - (F.lit(folds) - F.col("fold")) * F.col("_size")
    role = F.when(F.col("_i") < start, "train").when(F.col("_i") < start + F.col("_size"), "test")
    return numbered.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_i", "_n", "_size")


def stratified_folds(
    rows: DataFrame,
    order: Column,
    folds: int = 5,
    label: str = "Target_Label",
    stock: str = "Stock",
    first: str = "Target_Date",
    ranges: Callable[[Column], tuple[Column, Column]] | None = None,
) -> DataFrame:
    """``fold`` 0..folds-1 with classes spread evenly, filled in ``order`` within each class.

    Lay the classes end to end in the order they first appear; fold i gets as many rows of
    a class as the class has places p with p % folds = i. ``order`` must be unique in its
    class; with ``ranges`` (see :mod:`ordered`) a class may be of any size.
    """
    sizes = rows.groupBy(stock, label).agg(F.count(F.lit(1)).alias("_size"), F.min(first).alias("_first"))
    others = F.sum("_size").over(Window.partitionBy(stock).orderBy("_first", label).rowsBetween(Window.unboundedPreceding, -1))
    laid = sizes.select(stock, label, "_size", F.coalesce(others, F.lit(0)).alias("_s"))  # a row per class
    keyed = rows.withColumn("_o", order).withColumn("_one", F.lit(1))
    if ranges is None:
        w = Window.partitionBy(stock, label).orderBy("_o")
        ranked = keyed.withColumn("_one_before", F.row_number().over(w) - 1)
    else:
        ranked = running_totals(keyed, [stock, label], "_o", ["_one"], ranges(F.col("_o")))
    ranked = ranked.join(laid, [stock, label]) if ranges is None else join_spread(ranked, laid, [stock, label], F.col("_o"))

    def places(i: int) -> Column:
        last = F.floor((F.col("_s") + F.col("_size") - 1 - i) / folds)
        return last - F.floor((F.col("_s") - 1 - i) / folds)

    fold, filled = F.lit(0), F.lit(0)
    for i in range(folds - 1):
        filled = filled + places(i)
        fold = fold + (F.col("_one_before") >= filled).cast("int")
    return ranked.withColumn("fold", fold.cast("int")).select(*rows.columns, "fold")
