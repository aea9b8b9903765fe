"""Forests and boosted trees of all symbols in grouped plans; a tree is a row.

Features are cut into bins at quantiles of the fit rows. A node's split is the one of highest gain over the sums of two
numbers per bin, slope and curvature: with slope = weight * label and curvature = weight that gain is the drop of the
weighted Gini impurity (forests), with the two derivatives of the logistic loss it is the drop of the loss, with L1, L2
and a least gain (boosting). Rows and features of a tree are drawn by a hash of symbol, fold and tree, so reruns agree.

Forests are fitted in blocks of trees, boosted trees in one group per symbol and fold, each in one job whatever the
number of symbols. A group holds one symbol's rows, one per trading day.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ticktide.session import written

BINS = 32
#: Trees that are fitted together.
BLOCK = 50
KEY = ["Stock", "fold"]
NODES = "feature array<int>, cut array<double>, value array<double>, gain array<double>"
TREE = f"Stock string, fold int, tree int, {NODES}"


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``features`` are drawn anew for each node, or for each tree."""

    depth: int
    leaf_rows: int = 1
    leaf_curvature: float = 0.0
    features: float | str = "sqrt"
    per_node: bool = True
    l1: float = 0.0
    l2: float = 0.0
    least_gain: float = 0.0

    def drawn(self, rng: np.random.Generator, dim: int) -> np.ndarray:
        n = int(np.ceil(np.sqrt(dim))) if self.features == "sqrt" else max(1, int(self.features * dim))
        return np.sort(rng.choice(dim, min(n, dim), replace=False))


def drawing(*name: object) -> np.random.Generator:
    """Random numbers that depend on the name alone."""
    return np.random.default_rng(list(hashlib.md5("|".join(map(str, name)).encode()).digest()))


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values between bins: midpoints of neighbours, at quantiles where there are too many."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= bins:
            middle = np.unique(middle[np.searchsorted(values, np.quantile(column, np.arange(1, bins) / bins), "left").clip(0, len(middle) - 1)])
        edges.append(middle)
    return edges


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]).astype(np.int64)


def _pulled(slope: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(slope) * np.maximum(np.abs(slope) - l1, 0.0)


def _score(slope: np.ndarray, curvature: np.ndarray, g: Growth) -> np.ndarray:
    return np.divide(_pulled(slope, g.l1) ** 2, curvature + g.l2, out=np.zeros_like(slope), where=curvature + g.l2 > 0)


def grow(cells: np.ndarray, edges: Sequence[np.ndarray], slope: np.ndarray, curvature: np.ndarray, g: Growth, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays by node, children of k at 2k+1 (at or below the cut) and 2k+2; feature -1 is a leaf."""
    n_nodes = 2 ** (g.depth + 1) - 1
    feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes)
    value, gain = np.zeros(n_nodes), np.zeros(n_nodes)
    rows = {0: np.arange(len(cells))}
    width = max((len(e) for e in edges), default=0) + 1
    of_tree = g.drawn(rng, cells.shape[1])
    for node in range(n_nodes):
        if node not in rows:
            continue
        own = rows.pop(node)
        s, c = slope[own].sum(keepdims=True), curvature[own].sum(keepdims=True)
        value[node] = (_pulled(s, g.l1) / (c + g.l2))[0] if c[0] + g.l2 > 0 else 0.0
        if 2 * node + 2 >= n_nodes or len(own) < 2 * g.leaf_rows:
            continue
        drawn = g.drawn(rng, cells.shape[1]) if g.per_node else of_tree
        at = (cells[np.ix_(own, drawn)] + np.arange(len(drawn)) * width).ravel()
        sums = lambda w: np.bincount(at, w, len(drawn) * width).reshape(len(drawn), width).cumsum(axis=1)[:, :-1]
        left_s, left_c, left_n = (sums(np.repeat(w, len(drawn))) for w in (slope[own], curvature[own], np.ones(len(own))))
        gains = _score(left_s, left_c, g) + _score(s - left_s, c - left_c, g) - _score(s, c, g)
        allowed = (left_n >= g.leaf_rows) & (len(own) - left_n >= g.leaf_rows) & (left_c >= g.leaf_curvature) & (c - left_c >= g.leaf_curvature)
        allowed &= np.arange(width - 1) < np.array([len(edges[f]) for f in drawn])[:, None]
        gains = np.where(allowed, gains, -np.inf)
        if not gains.size or gains.max() / 2 - g.least_gain <= 1e-12:
            continue
        f, b = np.unravel_index(gains.argmax(), gains.shape)
        feature[node], cut[node], gain[node] = drawn[f], edges[drawn[f]][b], gains[f, b]
        below = cells[own, drawn[f]] <= b
        rows[2 * node + 1], rows[2 * node + 2] = own[below], own[~below]
    return {"feature": feature, "cut": cut, "value": value, "gain": gain}


def walked(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value of the leaf that every row of ``x`` ends in."""
    node = np.zeros(len(x), np.int64)
    while True:
        f = tree["feature"][node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return tree["value"][node]
        node[inner] = 2 * node[inner] + 1 + (x[inner, f[inner]] > tree["cut"][node[inner]])


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_numpy()).astype(float)


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in order of day, so that what is drawn does not depend on how they arrive."""
    return rows.sort_values("Target_Date", kind="stable", ignore_index=True)


# ---- forests ------------------------------------------------------------------------


def fit_forest(rows: DataFrame, trees: int, growth: Growth, sample: float = 0.8, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """TREE rows of every (Stock, fold); ``rows`` holds KEY, Target_Date, label, weight and x.

    A tree's value is the weighted share of label 1; its rows are drawn without repeats.
    """

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = _ordered(own)
        stock, fold, first = own["Stock"].iloc[0], int(own["fold"].iloc[0]), int(own["block"].iloc[0]) * block
        x, w = _matrix(own), own["weight"].to_numpy()
        edges = bin_edges(x)
        cells, slope = binned(x, edges), w * own["label"].to_numpy()
        out = []
        for tree in range(first, min(first + block, trees)):
            rng = drawing(seed, stock, fold, tree)
            drawn = np.flatnonzero(rng.random(len(own)) < sample)
            drawn = drawn if len(drawn) else np.arange(len(own))
            out.append({"Stock": stock, "fold": fold, "tree": tree, **grow(cells[drawn], edges, slope[drawn], w[drawn], growth, rng)})
        return pd.DataFrame(out)

    blocks = F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // block))).alias("block")
    given = rows.select(*KEY, "Target_Date", "label", "weight", "x", blocks)
    return given.groupBy(*KEY, "block").applyInPandas(fit, TREE)


def score_trees(rows: DataFrame, trees: DataFrame, keep: Sequence[str], boosted: bool = False) -> DataFrame:
    """KEY, ``keep`` and y_prob of every row whose (Stock, fold) has trees, by one join of the two.

    Forests average their trees; boosted trees add up to log-odds.
    """
    given = rows.select(*KEY, *keep, "x")
    schema = given.drop("x").schema.add("y_prob", "double")
    schema_of = to_arrow_schema(schema)

    def score(own: pa.Table, fitted: pa.Table) -> pa.Table:
        if not own.num_rows or not fitted.num_rows:
            return schema_of.empty_table()
        x = np.array(own["x"].to_pylist(), float)
        total = np.zeros(len(x))
        for t in fitted.sort_by("tree").to_pylist():  # in one order, so sums agree to the last bit
            total += walked({k: np.array(t[k]) for k in ("feature", "cut", "value")}, x)
        p = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if boosted else total / fitted.num_rows
        return own.drop_columns(["x"]).append_column("y_prob", pa.array(p))

    return given.groupBy(*KEY).cogroup(trees.select(*KEY, "tree", "feature", "cut", "value").groupBy(*KEY)).applyInArrow(score, schema)


def importances(trees: DataFrame) -> DataFrame:
    """Stock, fold, feature and its share of the gains: a tree's gains add up to 1, then all trees' do."""
    nodes = trees.select(*KEY, "tree", F.explode(F.arrays_zip("feature", "gain")).alias("n")).filter("n.feature >= 0")
    per_tree = nodes.groupBy(*KEY, "tree", F.col("n.feature").alias("feature")).agg(F.sum("n.gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy(*KEY, "tree"))  # a tree has a few features
    per_feature = per_tree.withColumn("share", share).groupBy(*KEY, "feature").agg(F.sum("share").alias("share"))
    total = F.sum("share").over(Window.partitionBy(*KEY))
    return per_feature.select(*KEY, "feature", (F.col("share") / total).alias("importance"))


def named(importance: DataFrame, components: DataFrame, others: Sequence[str], prefix: str = "pca_") -> DataFrame:
    """Stock, feature and importance; features beyond a symbol's ``components`` are ``others`` in order."""
    place = F.col("feature") - F.col("components")
    name = F.when(place < 0, F.concat(F.lit(prefix), F.col("feature").cast("string"))).otherwise(F.get(F.array(*map(F.lit, others)), place))
    return importance.join(components.select("Stock", "components"), "Stock").select("Stock", name.alias("feature"), "importance")


# ---- boosted trees ------------------------------------------------------------------


def log_loss(y: np.ndarray, odds: np.ndarray) -> float:
    return float(np.logaddexp(0.0, -(2 * y - 1) * odds).mean())


@dataclass(frozen=True)
class Boosting:
    rounds: int = 500
    rate: float = 0.05
    sample: float = 0.8
    patience: int = 20
    growth: Growth = Growth(depth=3, leaf_curvature=5.0, features=0.05, per_node=False, l1=0.1, l2=1.0, least_gain=1.0)


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, val_x: np.ndarray, val_y: np.ndarray, how: Boosting, *name: object) -> list[dict[str, np.ndarray]]:
    """Trees up to the round of the lowest validation loss; all rounds if there are no validation rows."""
    edges = bin_edges(x)
    cells, odds, val_odds = binned(x, edges), np.zeros(len(x)), np.zeros(len(val_x))
    trees, best, least = [], 0, np.inf
    for k in range(how.rounds):
        rng = drawing(*name, k)
        p = 1 / (1 + np.exp(-odds))
        drawn = np.flatnonzero(rng.random(len(x)) < how.sample)
        drawn = drawn if len(drawn) else np.arange(len(x))
        tree = grow(cells[drawn], edges, (w * (y - p))[drawn], (w * p * (1 - p))[drawn], how.growth, rng)
        tree["value"] = tree["value"] * how.rate
        trees.append(tree)
        odds += walked(tree, x)
        if len(val_x):
            val_odds += walked(tree, val_x)
            loss = log_loss(val_y, val_odds)
            if loss < least:
                best, least = k + 1, loss
            elif k + 1 - best >= how.patience:
                break
    return trees[:best] if len(val_x) else trees


def fit_boosting(rows: DataFrame, how: Boosting = Boosting(), seed: int = 42) -> DataFrame:
    """TREE rows of every (Stock, fold), fitted on the train rows and stopped early on the val rows.

    ``rows`` holds KEY, Target_Date, split, label, weight and x.
    """

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = _ordered(own)
        stock, fold = own["Stock"].iloc[0], int(own["fold"].iloc[0])
        train, val = own[own["split"] == "train"], own[own["split"] == "val"]
        if train.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in TREE.split(", ")])
        x = _matrix(val) if len(val) else np.zeros((0, 1))
        trees = boosted(_matrix(train), train["label"].to_numpy(), train["weight"].to_numpy(), x, val["label"].to_numpy(), how, seed, stock, fold)
        return pd.DataFrame([{"Stock": stock, "fold": fold, "tree": k, **t} for k, t in enumerate(trees)])

    return rows.select(*KEY, "Target_Date", "split", "label", "weight", "x").groupBy(*KEY).applyInPandas(fit, TREE)


# ---- folds --------------------------------------------------------------------------


def cross_scores(folded: DataFrame, trees: int, growth: Growth, keep: Sequence[str], sample: float = 0.8, seed: int = 42) -> DataFrame:
    """KEY, ``keep`` and y_prob of every row of ``folded`` (Stock, fold, Target_Date, label, weight, x) from a forest of the other folds.

    The fold is one more key of the fit: two jobs, whatever the number of symbols and folds.
    """
    of = written(folded.select(F.col("fold").alias("own_fold"), *[c for c in folded.columns if c != "fold"]), "folds")
    every = of.select("own_fold").distinct().agg(F.sort_array(F.collect_set("own_fold"))).scalar()  # a few folds
    train = of.withColumn("fold", F.explode(every)).filter("fold <> own_fold")
    fitted = written(fit_forest(train, trees, growth, sample, seed), "forests")
    return score_trees(of.withColumnRenamed("own_fold", "fold"), fitted, keep)


def with_fold(rows: DataFrame, features: Column) -> DataFrame:
    """Feature rows as the fits want them: ``x``, and fold -1 for a fit on all."""
    return rows.withColumn("x", features).withColumn("fold", F.lit(-1))
