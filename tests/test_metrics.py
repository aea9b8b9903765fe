import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktide.operators import metrics as M
from ticktide.operators.ordered import hash_ranges, running_totals, score_ranges


def scored(spark, rows):
    return spark.createDataFrame([("m", "A", y, p) for y, p in rows], "model string, Stock string, y_true int, y_prob double")


def brute_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    if not pos or not neg:
        return 0.5
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 3, 9])
def test_auc_is_that_of_all_pairs(spark, digits):
    random.seed(digits)
    rows = [(random.randint(0, 1), round(random.random() ** 3, digits)) for _ in range(200)]
    got = M.roc_auc(scored(spark, rows)).first().auc_roc
    assert got == pytest.approx(brute_auc(rows), abs=1e-12)
    mirrored = M.roc_auc(scored(spark, [(y, 1 - p) for y, p in rows])).first().auc_roc
    assert mirrored == pytest.approx(1 - got, abs=1e-12)


def test_auc_of_ties_and_of_one_class(spark):
    assert M.roc_auc(scored(spark, [(0, 0.3), (1, 0.3), (1, 0.3)])).first().auc_roc == 0.5
    assert M.roc_auc(scored(spark, [(1, 0.1), (1, 0.9)])).first().auc_roc == 0.5


def test_roc_curve_drops_points_on_a_line(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.6), (1, 0.2)]
    points = lambda drop: sorted((r.fpr, r.tpr) for r in M.roc_curve(scored(spark, rows), drop_intermediate=drop).collect())
    assert points(False) == [(0, 0), (0, 1 / 3), (0, 2 / 3), (0.5, 2 / 3), (1, 2 / 3), (1, 1)]
    assert points(True) == [(0, 0), (0, 1 / 3), (0, 2 / 3), (1, 2 / 3), (1, 1)]


def test_running_totals_equal_a_plain_window(spark):
    random.seed(5)
    values = random.sample([i / 10_000 for i in range(10_000)], 500)
    df = spark.createDataFrame([("g" if i % 3 else "h", v, i) for i, v in enumerate(values)], "g string, o double, x long")
    for descending in (False, True):
        order = F.desc("o") if descending else F.asc("o")
        w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        want = sorted(df.select("o", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("b")).collect())
        got = running_totals(df, ["g"], "o", ["x"], score_ranges(F.col("o"), bits=4), descending)
        assert sorted(got.select("o", F.col("x_before").alias("b")).collect()) == want


def test_confusion_arithmetic_of_published_reports(spark):
    # tn, fp, fn, tp with the accuracy, F1, precision and recall published for them
    golden = [(39, 0, 21, 0, 0.65, 0.0, 0.0, 0.0), (15, 24, 6, 15, 0.5, 0.5, 0.3846, 0.7143)]
    cells = spark.createDataFrame([g[:4] for g in golden], "tn long, fp long, fn long, tp long")
    for r, g in zip(M.rates(cells).collect(), golden):
        assert tuple(round(x, 4) for x in (r.accuracy, r.f1_score, r.precision_up, r.recall_up)) == g[4:]


def test_report_of_a_published_matrix(spark):
    cells = spark.createDataFrame([("svm", "A", 39, 0, 21, 0)], "model string, Stock string, tn long, fp long, fn long, tp long")
    got = {r.row: (round(r.precision, 2), round(r.recall, 2), round(r.f1_score, 2), r.support) for r in M.classification_report(cells).collect()}
    assert got == {"Down/Flat": (0.65, 1.0, 0.79, 39), "Up": (0.0, 0.0, 0.0, 21), "accuracy": (0.65, 0.65, 0.65, 60),
                   "macro avg": (0.33, 0.5, 0.39, 60), "weighted avg": (0.42, 0.65, 0.51, 60)}


def expected_folds(labels, k=5):
    """Places of each class laid end to end, then filled in row order."""
    classes = list(dict.fromkeys(labels))
    laid = sorted(range(len(labels)), key=lambda i: (classes.index(labels[i]), i))
    out = {}
    for c in classes:
        places = [p for p, i in enumerate(laid) if labels[i] == c]
        fold_of = [f for f in range(k) for p in places if p % k == f]
        out.update(zip([i for i, x in enumerate(labels) if x == c], fold_of))
    return [out[i] for i in range(len(labels))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stratified_folds(spark, seed):
    random.seed(seed)
    labels = [int(random.random() < 0.4) for _ in range(43)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(labels)], "Stock string, i int, Target_Label int")
    got = [r.fold for r in M.stratified_folds(df, F.col("i"), first="i").orderBy("i").collect()]
    assert got == expected_folds(labels)
    hashed = df.withColumn("h", F.md5(F.col("i").cast("string")))
    plain = M.stratified_folds(hashed, F.col("h"), first="i").orderBy("i").collect()
    ranged = M.stratified_folds(hashed, F.col("h"), first="i", ranges=hash_ranges).orderBy("i").collect()
    assert plain == ranged


def test_compare_and_pick(spark):
    s = "model string, Stock string, accuracy double, auc_roc double, f1_score double, model_rank int"
    a = spark.createDataFrame([("rf", "A", .5, .60, .1, 0), ("rf", "B", .5, .50, .1, 0), ("rf", "C", .5, .505, .1, 0), ("rf", "D", .5, .5, .1, 0)], s)
    b = spark.createDataFrame([("rf", "A", .5, .50, .1, 0), ("rf", "B", .5, .60, .1, 0), ("rf", "C", .5, .500, .1, 0)], s)
    assert {r.Stock: r.winner for r in M.compare_reports(a, b).collect()} == {"A": "TF-IDF", "B": "embedding", "C": "tie", "D": "N/A"}
    assert M.compare_chart(a, b).count() == 3 and M.compare_chart(a, b.limit(0)).count() == 4
    reports = spark.createDataFrame([("lstm", "A", .5, .6, .1, 0), ("rf", "A", .5, .6, .1, 1), ("rf", "B", .5, .7, .1, 1)], s)
    results = spark.createDataFrame([("A", "lstm", "Up")], "Stock string, model string, label string")
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "Stock string")
    got = {r.Stock: (r.model, r.label) for r in M.pick_best_model(reports, results, symbols).collect()}
    assert got == {"A": ("lstm", "Up"), "B": ("rf", None), "C": ("lstm", None)}


def test_best_epoch_takes_the_first(spark):
    rows = [("A", m, e, v) for m, vs in {"val_loss": [.7, .5, .5], "accuracy": [.1, .2, .3], "val_accuracy": [.4, .5, .6]}.items() for e, v in enumerate(vs, 1)]
    r = M.best_epoch(spark.createDataFrame(rows, "Stock string, metric string, epoch int, value double")).first()
    assert (r.best_epoch, r.total_epochs, r.train_acc, r.val_acc) == (2, 3, 0.2, 0.5)
