"""Classifiers per symbol: features, grouped fits, scores and reports.

Everything is a grouped plan over all symbols: the number of jobs depends on no list of them. A symbol's rows are one
per trading day, so its fits are groups of bounded size; the group of all symbols is fitted by summed moments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions import vectors as V
from ticktide.functions.display import half_even
from ticktide.operators import embedding_quality as E
from ticktide.operators import logistic
from ticktide.operators import metrics as M
from ticktide.operators import panel as P
from ticktide.operators import scaling as S
from ticktide.operators import trees
from ticktide.operators.ordered import hash_ranges
from ticktide.session import written

LABEL = "Target_Label"


# ---- features -----------------------------------------------------------------------

def lagged_prices(panel: DataFrame) -> DataFrame:
    """Price columns of the row before, so that a day's own open cannot give its label away."""
    w = Window.partitionBy("Stock").orderBy("Target_Date")
    moved = {c: F.lag(c).over(w) for c in P.PRICE_COLUMNS}
    return panel.withColumns(moved).filter(F.col("Open").isNotNull())


def scaled_parts(panel: DataFrame, vec: str = "vec", prices: Sequence[str] = P.PRICE_COLUMNS) -> DataFrame:
    """Split rows with ``vec`` and ``price`` scaled per symbol on its train part."""
    rows = P.chrono_split(panel).select(
        "Stock", "Target_Date", "split", LABEL, V.nan_to_num(F.col(vec)).alias("vec"),
        V.nan_to_num(F.array(*[F.col(c).cast("double") for c in prices])).alias("price"),
    )
    both = rows.withColumn("_all", F.concat("vec", "price"))
    scaled = S.standard_scale(both, "_all", train=F.col("split") == "train")
    dim = F.size("vec")
    return scaled.select(
        "Stock", "Target_Date", "split", LABEL, F.slice("_all", F.lit(1), dim).alias("vec"),
        F.slice("_all", dim + 1, F.size("price")).alias("price"),
    )


@dataclass
class Reduced:
    rows: DataFrame
    variance: DataFrame
    components: DataFrame


def _moments(group: str, vec: str):
    """Rows, sum and sum of outer products of each run of one group; tasks hold their rows in order of groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, s, q = None, 0, None, None
        line = lambda: pd.DataFrame({group: [now], "n": [n], "s": [s], "q": [q.ravel()]})
        for frame in frames:
            for name, part in frame.groupby(group, sort=False, dropna=False):
                x = np.stack(part[vec].to_numpy())
                if n and name != now:
                    yield line()
                    n = 0
                if n == 0:
                    now, s, q = name, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        if n:
            yield line()

    return run


def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances and unit components of the rows of ``x``, largest first.

    Of fewer rows than dimensions the n x n products of rows are decomposed and mapped back; further components are
    directions in which nothing varies.
    """
    n, dim = x.shape
    centred = x - x.mean(axis=0)
    if n >= dim:
        values, vectors = np.linalg.eigh(centred.T @ centred / max(n - 1, 1))
        return np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    values, vectors = np.linalg.eigh(centred @ centred.T / max(n - 1, 1))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    varies = values > values.max(initial=0.0) * dim * np.finfo(float).eps
    mapped = vectors[varies] @ centred
    mapped /= np.linalg.norm(mapped, axis=1, keepdims=True)
    # the rest of a whole basis: what is left of the axes once the components are taken out
    rest = np.linalg.svd(mapped, full_matrices=True)[2][len(mapped) :] if len(mapped) else np.eye(dim)
    return np.concatenate((values[varies], np.zeros(dim - varies.sum()))), np.concatenate((mapped, rest))


def pca_basis(
    rows: DataFrame, vec: str = "vec", variance: float | None = 0.90, k: int | None = None, group: str = "Stock", by_rows: bool = False
) -> DataFrame:
    """(group, ratios, components, basis) of every group in one plan.

    Tasks add up moments, so a group travels as one dim x dim matrix per task that holds rows of it,
    and one call decomposes each group's sum. ``by_rows`` gathers a group's rows instead: for wide vectors
    of groups that have few rows, as a symbol's train days. The largest entry of a basis vector is positive.
    Keeps the fewest components whose variance adds up to more than ``variance``, or ``k``; all, if nothing varies.
    """
    given = rows.filter(F.col(group).isNotNull()).select(group, vec)
    if by_rows:
        parts = given
    else:
        parts = given.sortWithinPartitions(group).mapInPandas(_moments(group, vec), f"`{group}` string, n long, s array<double>, q array<double>")

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        if by_rows:
            values, vectors = principal(np.stack(pdf[vec].to_numpy()))
            dim = len(values)
        else:
            n, s = pdf["n"].sum(), np.sum(np.stack(pdf["s"].to_numpy()), axis=0)
            dim = len(s)
            q = np.sum(np.stack(pdf["q"].to_numpy()), axis=0).reshape(dim, dim)
            values, vectors = np.linalg.eigh((q - np.outer(s, s) / n) / max(n - 1, 1))
            values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
        total = values.sum()
        ratios = values / total if total > 0 else np.zeros(dim)
        reached = np.flatnonzero(np.cumsum(ratios) > variance) if k is None else np.array([min(k, dim) - 1])
        keep = int(reached[0]) + 1 if len(reached) else dim
        signs = np.sign(vectors[np.arange(dim), np.abs(vectors).argmax(axis=1)])
        basis = [list(v) for v in (vectors * signs[:, None])[:keep]]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "ratios": [ratios], "components": [keep], "basis": [basis]})

    return parts.groupBy(group).applyInPandas(
        decompose, f"`{group}` string, ratios array<double>, components int, basis array<array<double>>"
    )


def pca_reduce(
    rows: DataFrame, vec: str = "vec", variance: float | None = 0.90, k: int | None = None, train: Column | None = None, group: str = "Stock",
    by_rows: bool = False,
) -> Reduced:
    """Turn ``vec`` per group into its components on the train rows; groups without train rows are left out.

    Rows must be centred on the train part (see scaling). The number of jobs does not depend on
    the number of groups, and a group may hold any share of the rows.
    """
    basis = written(pca_basis(rows if train is None else rows.filter(train), vec, variance, k, group, by_rows), "basis")
    joined = P.join_hot_keys(rows, basis.select(group, "basis"), group, F.hash(vec))
    projected = F.transform("basis", lambda b: V.dot(F.col(vec), b))
    out = joined.withColumn(vec, projected).select(*rows.columns)
    curve = basis.select(group, F.posexplode("ratios").alias("component", "ratio"))
    return Reduced(out, curve, basis.select(group, "components"))


def variance_curve(variance: DataFrame, group: str = "Stock") -> DataFrame:
    """Cumulative explained variance per component (scree)."""
    w = Window.partitionBy(group).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return variance.select(group, "component", "ratio", F.sum("ratio").over(w).alias("cumulative"))


def weighted(rows: DataFrame, train: Column | None = None, spread: Column | None = None) -> DataFrame:
    """Balanced class weights of the train part on every row; ``spread`` as in :func:`scaling.standard_scale`."""
    fitted = M.class_weights(rows if train is None else rows.filter(train))
    both = rows.join(fitted, "Stock") if spread is None else P.join_spread(rows, fitted, ["Stock"], spread)
    return both.withColumn("weight", F.when(F.col(LABEL) == 1, F.col("weight_1")).otherwise(F.col("weight_0"))).drop("weight_0", "weight_1")


def up_weighted(rows: DataFrame, train: Column | None = None) -> DataFrame:
    """Weight 1 on Down rows, Down to Up of the train part on Up rows; symbols of one class drop out."""
    fit_on = rows if train is None else rows.filter(train)
    fitted = M.scale_pos_weight(fit_on).join(M.class_weights(fit_on).select("Stock"), "Stock", "left_semi")
    both = rows.join(fitted, "Stock")
    return both.withColumn("weight", F.when(F.col(LABEL) == 1, F.col("scale_pos_weight")).otherwise(1.0)).drop("scale_pos_weight")


IN_TRAIN = "split = 'train'"


def _ready(rows: DataFrame, features: Column, weigh: Callable[[DataFrame, Column], DataFrame] = weighted) -> DataFrame:
    """Feature rows written once to the shared folder: Stock, Target_Date, split, label, weight and x. The fits read them several times."""
    ready = weigh(rows, F.expr(IN_TRAIN)).select(
        "Stock", "Target_Date", "split", LABEL, "weight", F.col(LABEL).cast("double").alias("label"), features.alias("x"),
    )
    return written(ready, "features")


def forest_features(panel: DataFrame, variance: float = 0.90) -> tuple[DataFrame, Reduced]:
    """Scaled vector reduced by PCA, then the scaled prices."""
    reduced = pca_reduce(written(scaled_parts(panel), "scaled"), variance=variance, train=F.expr(IN_TRAIN))
    return _ready(reduced.rows, F.concat("vec", "price")), reduced


def margin_features(panel: DataFrame, variance: float = 0.95, by_rows: bool = False) -> tuple[DataFrame, Reduced]:
    """Vector and prices scaled together, then reduced by PCA."""
    rows = scaled_parts(panel).withColumn("vec", F.concat("vec", "price"))
    reduced = pca_reduce(written(rows, "scaled"), variance=variance, train=F.expr(IN_TRAIN), by_rows=by_rows)
    return _ready(reduced.rows, F.col("vec")), reduced


def plain_features(panel: DataFrame, weigh: Callable[[DataFrame, Column], DataFrame] = weighted, prices: bool = False) -> DataFrame:
    """The scaled vector as it is, with the scaled prices behind it if asked for."""
    return _ready(scaled_parts(panel), F.concat("vec", "price") if prices else F.col("vec"), weigh)


# ---- fitting and scoring ------------------------------------------------------------

FOREST = trees.Growth(depth=2, leaf_rows=10)
#: The archive's forest, fitted on train and validation rows.
DEEP_FOREST = trees.Growth(depth=5, leaf_rows=10)
KEEP = ("Target_Date", "split", LABEL)


def fit_forest(ready: DataFrame, n: int = 500, growth: trees.Growth = FOREST, fit_on: str = IN_TRAIN, sample: float = 0.8) -> DataFrame:
    """Trees of every symbol's forest, as rows; ``ready`` as of :func:`forest_features`."""
    rows = ready.filter(fit_on).withColumn("fold", F.lit(-1))
    return written(trees.fit_forest(rows, n, growth, sample), "trees")


def score_forest(ready: DataFrame, fitted: DataFrame, model: str = "rf", boosted: bool = False) -> DataFrame:
    """(Stock, Target_Date, split, label, model, y_prob) of every row whose symbol has trees."""
    scored = trees.score_trees(ready.withColumn("fold", F.lit(-1)), fitted, KEEP, boosted)
    return scored.select("Stock", *KEEP, F.lit(model).alias("model"), "y_prob")


def fit_boosting(ready: DataFrame, how: trees.Boosting = trees.Boosting()) -> DataFrame:
    """Boosted trees of every symbol, up to its best round."""
    return written(trees.fit_boosting(ready.filter("split <> 'test'").withColumn("fold", F.lit(-1)), how), "trees")


def evaluate(scored: DataFrame) -> DataFrame:
    """Test report with train accuracy, validation accuracy and the overfit gap."""
    rows = written(scored.withColumnRenamed(LABEL, "y_true"))
    report = M.train_report(rows.filter("split = 'test'"))
    hit = ((F.col("y_prob") >= 0.5).cast("int") == F.col("y_true")).cast("double")
    accuracy = lambda part: half_even(F.avg(F.when(F.col("split") == part, hit)))
    parts = rows.groupBy("model", "Stock").agg(accuracy("train").alias("train_acc"), accuracy("val").alias("val_acc"))
    return report.join(parts, ["model", "Stock"]).withColumn("overfit_gap", half_even(F.col("train_acc") - F.col("accuracy")))


def cv_report(scored: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of AUC and accuracy; ``scored`` holds Stock, fold, y_true and y_prob."""
    rows = written(scored.select("Stock", "fold", "y_true", "y_prob"), "cv")
    key = ["Stock", "fold"]
    per_fold = M.roc_auc(rows, key).join(M.rates(M.confusion_matrix(rows, key)).select(*key, "accuracy"), key)
    return per_fold.groupBy("Stock").agg(
        F.avg("auc_roc").alias("cv_auc_mean"), F.stddev_pop("auc_roc").alias("cv_auc_std"),
        F.avg("accuracy").alias("cv_acc_mean"), F.stddev_pop("accuracy").alias("cv_acc_std"),
    )


def cross_validate_forest(folded: DataFrame, n: int = 500, growth: trees.Growth = FOREST) -> DataFrame:
    """:func:`cv_report` of forests fitted on all folds but one; ``folded`` as of :func:`forest_features`, with ``fold``."""
    scored = trees.cross_scores(folded, n, growth, (LABEL,))
    return cv_report(scored.withColumnRenamed(LABEL, "y_true"))


def _logistic_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, reg: float, steps: int) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton steps that are halved until the loss falls."""
    w = w / w.sum()
    ridge = np.full(x.shape[1], reg)
    ridge[-1] = 0.0  # the last column is the intercept
    loss = lambda b: w @ np.logaddexp(0.0, -(2 * y - 1) * (x @ b)) + ridge @ (b * b) / 2
    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (w * (p - y)) + ridge * b
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b, before = b - size * step, now
        now = loss(b)
        if before - now < 1e-12:
            break
    return b


def fit_logistics(rows: DataFrame, reg: float = 0.01, steps: int = 100) -> DataFrame:
    """(Stock, weights) of every symbol in one job, a group per task; ``rows`` as of :func:`plain_features`.

    A group holds one symbol's train rows, one per trading day.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.stack(pdf["x"].to_numpy()), np.ones(len(pdf))])
        weights = _logistic_weights(x, pdf["label"].to_numpy(), pdf["weight"].to_numpy(), reg, steps)
        return pd.DataFrame({"Stock": [pdf["Stock"].iloc[0]], "weights": [weights]})

    given = rows.filter(IN_TRAIN).select("Stock", "label", "weight", "x")
    return given.groupBy("Stock").applyInPandas(fit, "Stock string, weights array<double>")


def score_weights(rows: DataFrame, fits: DataFrame, model: str, keep: Sequence[str] = KEEP) -> DataFrame:
    """(Stock, keep..., model, y_prob) of every symbol that has weights, by one join."""
    return rows.join(fits, "Stock").select("Stock", *keep, F.lit(model).alias("model"), logistic.chance(F.col("weights"), F.col("x")).alias("y_prob"))


def top_k_features(importance: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("Stock").orderBy(F.desc("importance"), F.asc("feature"))
    ranked = importance.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return ranked.withColumn("is_price", F.col("feature").isin(list(P.PRICE_COLUMNS)))


def probe_folds(rows: DataFrame, order: Column, k: int = 50, folds: int = 5) -> tuple[DataFrame, Reduced]:
    """Rows scaled and PCA-reduced per group, in shuffled folds, and the reduction; groups of one class drop out.

    ``rows``: Stock (a group name, maybe with most rows), Target_Label, key, vec.
    """
    scaled = written(S.standard_scale(rows, "vec", spread=F.col("key")))
    reduced = pca_reduce(scaled, k=k)
    kept = weighted(reduced.rows, spread=F.col("key"))
    return written(M.stratified_folds(kept, order, folds, first="key", ranges=hash_ranges), "folds"), reduced


def linear_probe(rows: DataFrame, order: Column, k: int = 50, folds: int = 5) -> DataFrame:
    """Balanced logistic regression on the rows of :func:`probe_folds`: five-fold accuracy and AUC per group."""
    return probe_of_folds(*probe_folds(rows, order, k, folds), k)


def probe_of_folds(folded: DataFrame, reduced: Reduced, k: int = 50) -> DataFrame:
    rows = folded.select("Stock", "fold", "key", "weight", F.col(LABEL).cast("double").alias("label"), F.col("vec").alias("x"))
    cv = cv_report(logistic.cross_scores(rows))
    kept = reduced.variance.filter(F.col("component") < k).groupBy("Stock").agg(F.sum("ratio").alias("pca_variance_explained"))
    return cv.join(kept, "Stock").select(
        "Stock", half_even(F.col("cv_acc_mean")).alias("logreg_acc"), half_even(F.col("cv_acc_std")).alias("logreg_acc_std"),
        half_even(F.col("cv_auc_mean")).alias("logreg_auc"), half_even(F.col("pca_variance_explained")).alias("pca_variance_explained"),
    )


def groups_fit(rows: DataFrame, minimum: int = E.MIN_ROWS) -> DataFrame:
    """(Stock, fit): whether a group has ``minimum`` rows and both classes."""
    two = (F.count(F.lit(1)) >= minimum) & (F.min(LABEL) != F.max(LABEL))
    return rows.groupBy("Stock").agg(two.alias("fit"))


def separability(rows: DataFrame, order: Column, minimum: int = E.MIN_ROWS) -> DataFrame:
    """Probe, nearest neighbours and silhouette of every group on its own scaled vectors.

    Groups of one class or with fewer than ``minimum`` rows keep a row of NULLs. ``rows`` as in :func:`probe_folds`.
    """
    groups = written(groups_fit(rows, minimum), "groups")
    rows = written(P.join_spread(rows, groups.filter("fit").select("Stock"), ["Stock"], F.col("key")), "probed")
    folded, reduced = probe_folds(rows, order)
    probe = probe_of_folds(folded, reduced)
    near = E.knn_accuracy(E.knn_vote(folded, label=LABEL, group="Stock"))
    shape = E.silhouette_by_group(S.standard_scale(rows, "vec", spread=F.col("key")))
    return (
        groups.select("Stock").join(probe, "Stock", "left")
        .join(near.select(F.col("grp").alias("Stock"), half_even(F.col("knn_acc")).alias("knn_acc")), "Stock", "left")
        .join(shape.select("Stock", half_even(F.col("silhouette")).alias("silhouette")), "Stock", "left")
    )
