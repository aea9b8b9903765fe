"""Grouped fits against plain versions, and their number of jobs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.operators import logistic, margins, recurrent, trees
from ticktide.operators import models as L

ROWS = "Stock string, fold int, Target_Date date, split string, label double, Target_Label int, weight double, x array<double>"


def made(spark, data, stocks=("A",), train=0.7, val=0.15):
    """Rows of every symbol from (x, y) pairs in order of day."""
    rows = []
    for s in stocks:
        for i, (x, y) in enumerate(data):
            split = "train" if i < train * len(data) else "val" if i < (train + val) * len(data) else "test"
            rows.append((s, -1, np.datetime64("2020-01-01").astype("O") + np.timedelta64(i, "D").astype("O"), split, float(y), int(y), 1.0 + i % 2, [float(v) for v in x]))
    return spark.createDataFrame(rows, ROWS)


def noisy(n, dim, seed, planted=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 2)
    return [(row, int(row[planted] + 0.3 * rng.normal() > 0)) for row in x]


def jobs(spark, work):
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    return found


# ---- trees --------------------------------------------------------------------------


def best_split(x, slope, curvature, g):
    """Every cut between two values of every feature: the highest gain, the first of equals."""
    def score(rows):
        s, c = slope[rows].sum(), curvature[rows].sum()
        return (np.sign(s) * max(abs(s) - g.l1, 0)) ** 2 / (c + g.l2)

    best = (0.0, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < g.leaf_rows or min(curvature[left].sum(), curvature[~left].sum()) < g.leaf_curvature:
                continue
            gain = score(left) + score(~left) - score(np.ones(len(x), bool))
            if gain / 2 - g.least_gain > 1e-12 and gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best


@pytest.mark.parametrize("g", [
    trees.Growth(depth=2, features=1.0, leaf_curvature=1.0, l1=0.1, l2=1.0, least_gain=0.2, per_node=False), trees.Growth(depth=3, features=1.0, leaf_rows=4),
])
def test_a_tree_is_that_of_a_search_over_all_cuts(g):
    data = noisy(25, 3, 1)
    x, y = np.array([r for r, _ in data]), np.array([float(y) for _, y in data])
    slope, curvature = y - 0.5, np.full(len(y), 0.25)
    edges = trees.bin_edges(x)
    tree = trees.grow(trees.binned(x, edges), edges, slope, curvature, g, np.random.default_rng(0))
    rows = {0: np.ones(len(x), bool)}
    for node in range(len(tree["feature"])):
        if node not in rows:
            continue
        own = np.flatnonzero(rows[node])
        s, c = slope[own].sum(), curvature[own].sum()
        assert tree["value"][node] == pytest.approx(np.sign(s) * max(abs(s) - g.l1, 0) / (c + g.l2))
        gain, f, cut = best_split(x[own], slope[own], curvature[own], g) if 2 * node + 2 < len(tree["feature"]) else (0, -1, 0)
        assert tree["feature"][node] == f
        if f >= 0:
            assert tree["gain"][node] == pytest.approx(gain)
            left = rows[node] & (x[:, f] <= cut)
            assert ((x[own, f] <= tree["cut"][node]) == left[own]).all()
            rows[2 * node + 1], rows[2 * node + 2] = left, rows[node] & ~left


def test_regularisation_prunes_and_shrinks():
    data = noisy(60, 4, 2)
    x, y = np.array([r for r, _ in data]), np.array([float(y) for _, y in data])
    edges = trees.bin_edges(x)
    make = lambda **k: trees.grow(trees.binned(x, edges), edges, y - 0.5, np.full(60, 0.25), trees.Growth(3, features=1.0, **k), np.random.default_rng(0))
    free = make()
    assert (make(least_gain=100.0)["feature"] == -1).all() and (make(l1=100.0)["value"] == 0).all()
    assert abs(make(l2=50.0)["value"]).max() < abs(free["value"]).max()


def test_forest_finds_the_planted_feature_and_scores(spark):
    rows = made(spark, noisy(200, 12, 3, planted=5), ("A", "B")).repartition(3)
    fitted = trees.fit_forest(rows.filter("split = 'train'"), 60, trees.Growth(depth=2, leaf_rows=10))
    top = trees.importances(fitted).filter("feature = 5").collect()
    assert len(top) == 2 and all(r["importance"] > 0.3 for r in top)
    sums = {r["Stock"]: r["s"] for r in trees.importances(fitted).groupBy("Stock").agg(F.sum("importance").alias("s")).collect()}
    assert sums == {"A": pytest.approx(1), "B": pytest.approx(1)}
    scored = trees.score_trees(rows, fitted, ("label", "split"))
    again = trees.score_trees(rows.repartition(2), trees.fit_forest(rows.filter("split = 'train'").repartition(5), 60, trees.Growth(depth=2, leaf_rows=10)), ("label", "split"))
    key = lambda df: sorted((r["Stock"], r["label"], r["y_prob"]) for r in df.collect())
    assert key(scored) == key(again)
    test = [r for r in scored.collect() if r["split"] == "test"]
    assert np.mean([(r["y_prob"] >= 0.5) == (r["label"] == 1) for r in test]) > 0.8
    named = trees.named(trees.importances(fitted), spark.createDataFrame([("A", 5), ("B", 3)], "Stock string, components int"), ["p", "q", "r"])
    found = {(r["Stock"], r["feature"]) for r in named.collect()}
    assert ("A", "p") in found and ("B", "r") in found


def test_boosting_stops_early_and_separates(spark):
    rows = made(spark, noisy(400, 6, 4), ("A",))
    how = trees.Boosting(rounds=200, rate=0.2, patience=10, growth=trees.Growth(depth=2, leaf_curvature=1.0, features=0.5, per_node=False, l1=0.1, l2=1.0, least_gain=0.1))
    fitted = trees.fit_boosting(rows.filter("split <> 'test'"), how)
    assert 5 < fitted.count() < 200
    scored = trees.score_trees(rows, fitted, ("label", "split"), boosted=True).filter("split = 'test'").collect()
    assert np.mean([(r["y_prob"] >= 0.5) == (r["label"] == 1) for r in scored]) > 0.8


def test_symbols_without_train_rows_or_of_one_class(spark):
    rows = made(spark, [([1.0, 2.0], 1)] * 5, ("A",), train=0.0, val=1.0)
    assert trees.fit_boosting(rows).count() == 0 and recurrent.fit(rows).count() == 0
    assert trees.score_trees(rows, trees.fit_boosting(rows), ("label",)).count() == 0
    alike = made(spark, [([1.0, float(i)], 1) for i in range(30)])
    p = trees.score_trees(alike, trees.fit_forest(alike, 5, trees.Growth(depth=2, leaf_rows=2)), ("label",)).collect()
    assert {r["y_prob"] for r in p} == {1.0}


def test_jobs_do_not_grow_with_the_symbols(spark):
    def work(n):
        rows = made(spark, noisy(40, 3, 5), [f"S{k}" for k in range(n)]).coalesce(1)
        fold = rows.withColumn("fold", (F.dayofmonth("Target_Date") % 2).cast("int")).withColumn("key", F.concat("Stock", F.col("Target_Date").cast("string")))

        def run():
            fitted = L.fit_forest(rows.drop("fold"), 6)
            L.score_forest(rows.drop("fold"), fitted).count()
            L.cross_validate_forest(fold, 4).count()
            L.fit_boosting(rows.drop("fold"), trees.Boosting(rounds=3)).count()
            margins.grid_search(rows.drop("fold"), (1.0,), (0.1,), 2, 16)[0].count()
            logistic.fit(fold, steps=2).count()

        return run

    assert jobs(spark, work(2)) == jobs(spark, work(30))


def test_cross_scores_never_see_their_own_fold(spark):
    rng = np.random.default_rng(6)
    data = [([float(i)], int(rng.integers(0, 2))) for i in range(60)]  # only learning by heart would score well
    rows = made(spark, data).withColumn("fold", (F.dayofyear("Target_Date") % 3).cast("int"))
    scored = trees.cross_scores(rows, 20, trees.Growth(depth=5, features=1.0), ("label",), sample=1.0).collect()
    assert len(scored) == 60 and np.mean([(r["y_prob"] >= 0.5) == (r["label"] == 1) for r in scored]) < 0.75


# ---- margins ------------------------------------------------------------------------


def xor(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return [(row, int(row[0] * row[1] > 0)) for row in x]


def test_kernel_margins_separate_what_a_line_can_not(spark):
    rows = made(spark, xor(300, 7), ("A", "B"))
    scored, best = margins.grid_search(rows, (0.1, 1.0, 10.0), ("scale", 0.001))
    assert {r["best_gamma"] for r in best.collect()} == {"scale"} and all(r["best_cv_auc"] > 0.9 for r in best.collect())
    test = scored.filter("split = 'test'").collect()
    assert np.mean([(r["y_prob"] >= 0.5) == (r["Target_Label"] == 1) for r in test]) > 0.85
    x, y = np.array([r for r, _ in xor(300, 7)]), np.array([y for _, y in xor(300, 7)])
    w = margins.margin_weights(np.column_stack([x, np.ones(300)]), 2.0 * y - 1, np.ones(300), 1.0)
    assert abs(np.mean((np.column_stack([x, np.ones(300)]) @ w > 0) == (y > 0)) - 0.5) < 0.12


def test_products_of_cosines_come_near_the_kernel():
    x = np.random.default_rng(1).normal(size=(40, 3))
    z = margins.cosines(x, 0.3, 4096)[:, :-1]
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.1
    assert margins.frequencies(3, 8)[0].tolist() == margins.frequencies(3, 8)[0].tolist()


def test_chances_are_calibrated():
    rng = np.random.default_rng(3)
    decision = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * decision - 0.7)))).astype(float)
    a, b = margins.sigmoid(decision, y)
    assert (a, b) == (pytest.approx(-1.5, abs=0.15), pytest.approx(0.7, abs=0.15))
    p = 1 / (1 + np.exp(a * decision + b))
    for low, high in itertools.pairwise(np.linspace(0, 1, 6)):
        own = (p >= low) & (p < high)
        assert y[own].mean() == pytest.approx(p[own].mean(), abs=0.07)
    assert margins.sigmoid(-decision, y) == (-1.0, 0.0)


# ---- probe --------------------------------------------------------------------------


def test_summed_moments_give_the_weights_of_a_gathered_fit(spark):
    rows = made(spark, noisy(150, 4, 8), ("A", "B")).withColumn("fold", F.when(F.col("Stock") == "A", 1).otherwise(0)).withColumn("key", F.col("Target_Date").cast("string"))
    got = {r["Stock"]: np.array(r["weights"]) for r in logistic.fit(rows.repartition(5)).collect()}
    data = noisy(150, 4, 8)
    x = np.column_stack([np.array([r for r, _ in data]), np.ones(150)])
    want = L._logistic_weights(x, np.array([float(y) for _, y in data]), 1.0 + np.arange(150) % 2, 0.01, 100)
    assert set(got) == {"A", "B"} and all(np.allclose(w, want, atol=1e-6) for w in got.values())


def test_steps_are_halved_where_the_loss_would_rise(spark):
    data = [([50.0 * (i % 2) + i / 7], int(i % 2 or i > 35)) for i in range(40)]
    rows = made(spark, data).withColumn("key", F.col("Target_Date").cast("string"))
    got = logistic.fit(rows, reg=1e-4).first()["weights"]
    x = np.column_stack([np.array([r for r, _ in data]), np.ones(40)])
    want = L._logistic_weights(x, np.array([float(y) for _, y in data]), 1.0 + np.arange(40) % 2, 1e-4, 200)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


# ---- net ----------------------------------------------------------------------------


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    how = recurrent.Training(units=3, dense=4, l2=0.01)
    net = recurrent.Net(5, how)
    flat, x, y, w = net.first(rng), rng.normal(size=(6, 5)), rng.integers(0, 2, 6).astype(float), rng.random(6) + 0.5
    masks = [(rng.random((6, n)) > 0.3) / 0.7 for n in (5, 4)]

    def loss(v):
        odds = net.forward(v, x, masks)[0]
        ridge = sum((p[:-1] ** 2).sum() for p in net.parts(v)[:2])
        return (w * np.logaddexp(0, -(2 * y - 1) * odds)).mean() + how.l2 * ridge

    slope, step = net.slope(flat, x, y, w, masks), 1e-6
    for k in rng.choice(net.size, 40, replace=False):
        e = np.zeros(net.size)
        e[k] = step
        assert slope[k] == pytest.approx((loss(flat + e) - loss(flat - e)) / (2 * step), abs=1e-6)


def test_history_and_best_epoch(spark):
    rows = made(spark, xor(240, 9), ("A", "B"))
    how = recurrent.Training(epochs=40, rate=0.01, patience=15, dropout=0.0)
    nets = recurrent.fit(rows, how)
    for r in nets.collect():
        losses = [e["val_loss"] for e in r["history"]]
        best = int(np.argmin(losses))
        assert len(losses) == 40 or len(losses) == best + 1 + how.patience
        val = recurrent.score(rows.filter("split = 'val'"), nets.filter(F.col("Stock") == r["Stock"]), ("Target_Label",), how).collect()
        p = np.array([v["y_prob"] for v in val])
        y = np.array([v["Target_Label"] for v in val])
        assert -np.log(np.where(y > 0, p, 1 - p)).mean() == pytest.approx(losses[best])
    best = {r["Stock"]: r for r in L.M.best_epoch(recurrent.history(nets)).collect()}
    assert set(best) == {"A", "B"} and all(0 <= r["val_acc"] <= 1 for r in best.values())
    test = recurrent.score(rows.filter("split = 'test'"), nets, ("Target_Label",), how).collect()
    assert np.mean([(r["y_prob"] >= 0.5) == (r["Target_Label"] == 1) for r in test]) > 0.75


# ---- components ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [6, 40])
def test_components_by_rows_equal_those_by_moments(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 12)) * np.arange(1, 13)
    df = spark.createDataFrame([("A", [float(v) for v in row]) for row in x - x.mean(axis=0)], "Stock string, vec array<double>").repartition(3)
    a, b = (L.pca_basis(df, variance=0.95, by_rows=by).first() for by in (False, True))
    assert a["components"] == b["components"] and np.allclose(a["ratios"], b["ratios"], atol=1e-9)
    assert np.allclose(a["basis"], b["basis"], atol=1e-6)
