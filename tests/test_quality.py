import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.operators import embedding_quality as E
from ticktide.functions import vectors as V
from ticktide.operators import margins
from ticktide.operators import models as L
from ticktide.operators.neighbours import nearest


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)) + 0.4
    x[7] = 0.0
    y = (rng.random(50) < 0.45).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, rows):
    x, y = rows
    data = [(f"{i:03d}", "A" if i < 30 else "B", int(y[i]), [float(v) for v in x[i]]) for i in range(50)]
    return spark.createDataFrame(data, "key string, Stock string, Target_Label int, vec array<double>")


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1e-8, n)


def test_cosines_equal_all_pairs(frame, rows):
    x, y = rows
    c = unit(x) @ unit(x).T
    r = E.cosine_quality(frame).filter("Stock = 'ALL'").first()
    assert r.cosine_intra_down == pytest.approx(c[np.ix_(y == 0, y == 0)].mean(), abs=1e-9)
    assert r.cosine_inter == pytest.approx(c[np.ix_(y == 0, y == 1)].mean(), abs=1e-9)
    assert r.anisotropy == pytest.approx(c[np.triu_indices(50, 1)].mean(), abs=1e-9)


def test_silhouette_equals_definition(frame, rows):
    x, y = rows
    d = np.linalg.norm(x[:, None] - x[None], axis=2) ** 2
    s = []
    for i in range(50):
        own, other = (y == y[i]), (y != y[i])
        a, b = d[i, own].sum() / (own.sum() - 1), d[i, other].mean()
        s.append((b - a) / max(a, b))
    got = E.silhouette(frame).filter("Stock = 'ALL'").first().silhouette
    assert got == pytest.approx(np.mean(s), abs=1e-6)


def test_silhouette_of_one_class_is_zero(frame):
    one = frame.withColumn("Target_Label", F.lit(1))
    assert {r.silhouette for r in E.silhouette(one).collect()} == {0.0}


@pytest.mark.parametrize("blocks", [1, 3])
def test_knn_equals_brute_force(frame, rows, blocks):
    x, y = rows
    folded = frame.withColumn("fold", (F.col("key").cast("int") % 5))
    votes = E.knn_vote(folded.withColumn("grp", F.lit("g")), label="Target_Label", unit_rows=-(-50 // blocks))
    got = {r.key: r.predicted for r in votes.collect()}
    dist = np.round(1 - unit(x) @ unit(x).T, 9)
    for i in range(50):
        near = sorted((dist[i, j], f"{j:03d}", y[j]) for j in range(50) if j % 5 != i % 5)[:5]
        assert got[f"{i:03d}"] == int(np.mean([n[2] for n in near]) > 0.5)


def test_neighbours_pass_over_cells_and_stay_exact(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 4)) * 3
    x = np.concatenate([centres[i % 8] + 0.1 * rng.normal(size=4) for i in range(400)]).reshape(400, 4)
    x[:30] = x[0]  # many rows alike
    x[40] = 0.0
    keys = [f"{i:03d}" for i in range(400)]
    df = spark.createDataFrame([(g, k, i % 2, i % 5, [float(v) for v in row]) for g in ("a", "b") for i, (k, row) in enumerate(zip(keys, x)) if g == "a" or i < 20],
                               "grp string, key string, y int, fold int, vec array<double>").repartition(3)
    rows = df.select("grp", "key", "y", "fold", V.unit(F.col("vec")).alias("u"))
    got = {}
    for r in nearest(rows, 5, unit_rows=40, pivots=12).collect():
        got.setdefault((r["grp"], r["key"]), []).append((r["place"], r["cand"], r["dist"]))
    u = unit(x)
    u[40] = 0.0
    dist = np.round(1 - u @ u.T, 9)
    for g, n in (("a", 400), ("b", 20)):
        for i in range(n):
            near = sorted((dist[i, j], keys[j]) for j in range(n) if j % 5 != i % 5)[:5]
            own = [(c, d) for _, c, d in sorted(got[g, keys[i]])]
            assert [d for _, d in own] == pytest.approx([d for d, _ in near], abs=2e-9)
            if all(b - a > 1e-8 for (a, _), (b, _) in zip(near, near[1:])):
                assert [c for c, _ in own] == [c for _, c in near]


def test_centroids(frame, rows):
    x, _ = rows
    c = np.stack([x[:30].mean(axis=0), x[30:].mean(axis=0)])
    cos = float(c[0] @ c[1] / (np.linalg.norm(c[0]) * np.linalg.norm(c[1])))
    got = E.centroid_similarity(frame).collect()
    assert [r.avg_off_diagonal for r in got] == pytest.approx([cos, cos], abs=1e-9)
    wide = {r.Stock: (r.A, r.B) for r in E.centroid_columns(frame, ["A", "B"]).collect()}
    assert wide["A"] == pytest.approx((1.0, cos), abs=1e-6)


def test_published_score_card(spark):
    given = spark.createDataFrame([(0.9638, 0.5177, 0.0, 0.7223)], "fisher_ratio double, logreg_auc double, silhouette double, anisotropy double")
    r = E.score_card(given).first()
    assert (r.overall_score, r.grade) == (30.0, "D")
    assert (r.separability_index, r.linear_probe_auc, r.silhouette_points, r.anisotropy_penalty) == (12.0, 1.2, 12.5, 4.2)


def test_fisher_ratio_without_spread(spark):
    d = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 3.0, 1.0)], "intra_l2_down double, intra_l2_up double, inter_l2 double")
    assert [r.fisher_ratio for r in E.fisher_ratio(d).collect()] == [0.0, 0.5]


def test_pca_keeps_enough_variance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5)) * np.array([5, 3, 1, 0.2, 0.1])
    x -= x.mean(axis=0)
    df = spark.createDataFrame([("A", [float(v) for v in row]) for row in x], "Stock string, vec array<double>")
    out = L.pca_reduce(df, variance=0.90)
    ratio = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    ratio /= ratio.sum()
    keep = int(np.argmax(np.cumsum(ratio) > 0.90)) + 1
    assert [tuple(r) for r in out.components.collect()] == [("A", keep)] and len(out.rows.first().vec) == keep
    vectors = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :keep]
    given = {tuple(r.vec) for r in out.rows.collect()}
    assert np.allclose(sorted(map(list, np.abs(list(given)))), sorted(np.abs(x @ vectors).tolist()))
    curve = [r.cumulative for r in L.variance_curve(out.variance).orderBy("component").collect()]
    assert curve == pytest.approx(np.cumsum(ratio).tolist(), abs=1e-9)


def test_pca_of_many_groups_is_one_plan(spark):
    """As many jobs for 200 groups as for 2; a group in several tasks, one of one row, one without spread."""
    rng = np.random.default_rng(3)
    tracker = spark.sparkContext.statusTracker()

    def run(n: int) -> tuple[dict[str, int], int]:
        rows = [(f"S{i:03d}", [float(v) for v in rng.normal(size=3)]) for i in range(n) for _ in range(9)]
        rows += [("one", [1.0, 2.0, 3.0]), ("flat", [1.0, 1.0, 1.0]), ("flat", [1.0, 1.0, 1.0])]
        df = spark.createDataFrame(rows, "Stock string, vec array<double>").repartition(3)
        spark.sparkContext.setJobGroup(f"pca{n}", "")
        out = L.pca_reduce(df, k=2)
        found = {r.Stock: len(r.vec) for r in out.rows.collect()}
        jobs = len(tracker.getJobIdsForGroup(f"pca{n}"))
        spark.sparkContext.setJobGroup("other", "")
        assert out.rows.count() == len(rows)
        return found, jobs

    few, jobs_few = run(2)
    many, jobs_many = run(200)
    assert len(few) == 4 and len(many) == 202 and set(many.values()) == {2}
    assert jobs_many <= jobs_few + 2


def test_logistic_fits_find_the_minimum(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(80, 3)), np.ones(80)])
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    w = np.where(y == 1, 2.0, 1.0)
    b = L._logistic_weights(x, y, w, 0.01, 100)
    p = 1 / (1 + np.exp(-x @ b))
    slope = x.T @ (w / w.sum() * (p - y)) + 0.01 * b * np.array([1, 1, 1, 0])
    assert np.abs(slope).max() < 1e-6
    alike = L._logistic_weights(x, np.ones(80), np.ones(80), 0.01, 100)  # one class: finite, on its side
    assert np.isfinite(alike).all() and (x @ alike > 0).all()


def test_margin_classifier_separates(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, 3)) + 3 * y[:, None]
    w = margins.margin_weights(np.column_stack([x, np.ones(60)]), np.where(y == 1, 1.0, -1.0), np.ones(60), 1.0)
    assert (((np.column_stack([x, np.ones(60)]) @ w) > 0) == (y == 1)).mean() > 0.95


def test_top_features_break_ties_by_name(spark):
    df = spark.createDataFrame([("A", "pca_1", .2), ("A", "pca_0", .2), ("A", "Open", .5)], "Stock string, feature string, importance double")
    assert [(r.feature, r.is_price) for r in L.top_k_features(df, 2).orderBy("place").collect()] == [("Open", True), ("pca_0", False)]


def test_separability_by_group(spark, frame, rows):
    """Groups are scaled and reduced by themselves; short ones and those of one class give NULLs."""
    x, y = rows
    short = frame.filter("key < '003'").withColumn("Stock", F.lit("short"))
    one = frame.filter("Target_Label = 1").unionByName(frame.filter("Target_Label = 0").withColumn("Target_Label", F.lit(1))).withColumn("Stock", F.lit("one"))
    every = E.with_all(frame).filter("Stock <> 'B'").unionByName(short).unionByName(one)
    order = E.shuffled(F.col("key"), 42)
    got = {r.Stock: r for r in L.separability(every, order).collect()}
    assert set(got) == {"A", "ALL", "short", "one"}
    for empty in ("short", "one"):
        assert set(got[empty].asDict().values()) == {empty, None}
    for group, n in (("A", 30), ("ALL", 50)):
        z = (x[:n] - x[:n].mean(axis=0)) / x[:n].std(axis=0)
        own = y[:n]
        folded, _ = L.probe_folds(every.filter(F.col("Stock") == group), order)
        fold = np.array([r.fold for r in folded.orderBy("key").collect()])
        near = np.round(1 - unit(z) @ unit(z).T, 9)  # all components are kept, so angles stay
        hits = []
        for f in range(5):
            votes = [np.mean([own[j] for j in sorted(np.flatnonzero(fold != f), key=lambda j: (near[i, j], j))[:5]]) > 0.5 for i in np.flatnonzero(fold == f)]
            hits.append(np.mean(np.array(votes) == own[fold == f]))
        assert got[group].knn_acc == pytest.approx(np.mean(hits), abs=1e-4)
        d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
        s = []
        for i in range(n):
            a, b = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1), d[i, own != own[i]].mean()
            s.append((b - a) / max(a, b))
        assert got[group].silhouette == pytest.approx(np.mean(s), abs=1e-4)
        assert 0 <= got[group].logreg_auc <= 1


def test_up_rows_weigh_as_scale_pos_weight(spark):
    rows = [("A", "train", int(i % 4 == 0)) for i in range(8)] + [("A", "test", 1), ("one", "train", 1)]
    df = spark.createDataFrame(rows, "Stock string, split string, Target_Label int")
    got = {(r.Stock, r.Target_Label): r.weight for r in L.up_weighted(df, F.expr(L.IN_TRAIN)).collect()}
    assert got == {("A", 0): 1.0, ("A", 1): 3.0}
