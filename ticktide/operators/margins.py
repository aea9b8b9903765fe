"""Margin classifiers with a radial kernel, for all symbols in grouped plans.

The kernel exp(-gamma |a - b|^2) is the mean product of random cosines (Fourier features), whose frequencies are drawn
from md5, so that any engine can repeat them; on these features the squared-hinge margin is linear. A grid over C and
gamma is judged on expanding time folds. Chances come from a sigmoid fitted to decisions on rows that the fit has not
seen. Groups hold one symbol's rows, one per trading day; the number of jobs does not depend on symbols or points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions.display import half_even
from ticktide.operators import metrics as M
from ticktide.session import written

COSINES = 256
GRID = (0.01, 0.1, 1.0, 10.0)
#: By the variance of the features, by their number, or as given.
GAMMAS: tuple[str | float, ...] = ("scale", "auto", 0.01, 0.001)
KEY = ["Stock", "fold"]
REFIT = -1
FITS = "Stock string, fold int, C double, gamma string, width double, weights array<double>"


def _uniform(name: str) -> tuple[float, float]:
    digest = hashlib.md5(name.encode()).hexdigest()
    return tuple((int(digest[k : k + 8], 16) + 0.5) / 2.0**32 for k in (0, 8))


@lru_cache(maxsize=4)
def frequencies(dim: int, cosines: int = COSINES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal frequencies, one row per cosine, and phases."""
    pairs = np.array([_uniform(f"{seed}:{i}:{j}") for i in range(cosines) for j in range(dim + 1)]).reshape(cosines, dim + 1, 2)
    normal = np.sqrt(-2 * np.log(pairs[:, :dim, 0])) * np.cos(2 * np.pi * pairs[:, :dim, 1])
    return normal, 2 * np.pi * pairs[:, dim, 0]


def cosines(x: np.ndarray, width: float, n: int = COSINES) -> np.ndarray:
    """Features whose inner products come near exp(-width |a - b|^2), and a last column of ones."""
    normal, phase = frequencies(x.shape[1], n)
    z = np.sqrt(2.0 / n) * np.cos(np.sqrt(2.0 * width) * (x @ normal.T) + phase)
    return np.column_stack([z, np.ones(len(z))])


def width_of(gamma: str | float, x: np.ndarray) -> float:
    if gamma == "scale":
        spread = x.var()
        return 1.0 / (x.shape[1] * spread) if spread > 0 else 1.0
    return 1.0 / x.shape[1] if gamma == "auto" else float(gamma)


def margin_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Squared-hinge linear margins: ridge regression on the rows inside the margin until they stay the same."""
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6  # the last column is the intercept
    inside, b = np.ones(len(y), dtype=bool), np.zeros(x.shape[1])
    for _ in range(steps):
        weighted = x[inside] * (2 * c * w[inside])[:, None]
        b = np.linalg.solve(ridge + weighted.T @ x[inside], weighted.T @ y[inside])
        now = y * (x @ b) < 1
        if (now == inside).all() or not now.any():
            break
        inside = now
    return b


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_numpy()).astype(float)


def fit_grid(rows: DataFrame, grid: Sequence[float] = GRID, gammas: Sequence[str | float] = GAMMAS, n: int = COSINES) -> DataFrame:
    """FITS rows of every (Stock, fold) and point of the grid; ``rows`` holds KEY, Target_Date, label, weight and x."""

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("Target_Date", kind="stable", ignore_index=True)
        x, y, w = _matrix(own), 2.0 * own["label"].to_numpy() - 1, own["weight"].to_numpy()
        name = {"Stock": own["Stock"].iloc[0], "fold": own["fold"].iloc[0]}
        out = []
        for gamma in gammas:
            width = width_of(gamma, x)
            z = cosines(x, width, n)
            out += [{**name, "C": c, "gamma": str(gamma), "width": width, "weights": margin_weights(z, y, w, c)} for c in grid]
        return pd.DataFrame(out)

    return rows.select(*KEY, "Target_Date", "label", "weight", "x").groupBy(*KEY).applyInPandas(fit, FITS)


def decisions(rows: DataFrame, fits: DataFrame, keep: Sequence[str], n: int = COSINES) -> DataFrame:
    """KEY, ``keep``, C, gamma and decision of every row for every fit of its (Stock, fold), by one join of the two."""
    given = rows.select(*KEY, *keep, "x")
    schema = given.drop("x").schema.add("C", "double").add("gamma", "string").add("decision", "double")

    def score(own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if own.empty or fitted.empty:
            return pd.DataFrame(columns=schema.names)
        x, parts, known = _matrix(own), [], {}
        for f in fitted.itertuples():
            if f.width not in known:
                known[f.width] = cosines(x, f.width, n)
            parts.append(own.drop(columns="x").assign(C=f.C, gamma=f.gamma, decision=known[f.width] @ np.asarray(f.weights)))
        return pd.concat(parts)[schema.names]

    return given.groupBy(*KEY).cogroup(fits.groupBy(*KEY)).applyInPandas(score, schema)


def sigmoid(decision: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a * decision + b)) by Newton steps on targets drawn in from 0 and 1.

    Where the fit would turn decisions round, as noise may, the plain logistic curve stands in.
    """
    up = y > 0
    target = np.where(up, (up.sum() + 1.0) / (up.sum() + 2.0), 1.0 / ((~up).sum() + 2.0))
    design = np.column_stack([decision, np.ones(len(decision))])
    loss = lambda v: (np.logaddexp(0.0, design @ v) - (1 - target) * (design @ v)).sum()
    v = np.array([0.0, np.log(((~up).sum() + 1.0) / (up.sum() + 1.0))])
    now = loss(v)
    for _ in range(steps):
        down = 1 / (1 + np.exp(-np.clip(design @ v, -500, 500)))  # chance of label 0
        slope = design.T @ (down - (1 - target))
        curve = (design.T * (down * (1 - down))) @ design + 1e-12 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-8 and loss(v - size * step) > now:
            size /= 2
        v, before = v - size * step, now
        now = loss(v)
        if before - now < 1e-12:
            break
    return (float(v[0]), float(v[1])) if v[0] < 0 else (-1.0, 0.0)


def calibrate(judged: DataFrame) -> DataFrame:
    """(Stock, a, b) from unseen decisions: Stock, label, decision."""

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["decision", "label"])
        a, b = sigmoid(own["decision"].to_numpy(), own["label"].to_numpy())
        return pd.DataFrame({"Stock": [own["Stock"].iloc[0]], "a": [a], "b": [b]})

    return judged.select("Stock", "label", "decision").groupBy("Stock").applyInPandas(fit, "Stock string, a double, b double")


def chance(decision: Column, a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.exp(a * decision + b) + 1.0)


def grid_search(
    rows: DataFrame, grid: Sequence[float] = GRID, gammas: Sequence[str | float] = GAMMAS, folds: int = 5, n: int = COSINES, model: str = "svm"
) -> tuple[DataFrame, DataFrame]:
    """Scored rows of each symbol's best point, refitted on train and val rows; and (Stock, best_C, best_gamma, best_cv_auc).

    ``rows`` holds Stock, Target_Date, split, Target_Label, label, weight and x. A point's measure is its mean AUC over
    expanding time folds; ties go to the smaller C, then to the gamma named first.
    """
    fit_on = rows.filter("split <> 'test'").select("Stock", "Target_Date", "label", "weight", "x")
    folded = written(M.time_series_folds(fit_on, folds).select("Stock", "fold", "role", "Target_Date", "label", "weight", "x"), "folds")
    refit = fit_on.withColumn("fold", F.lit(REFIT)).withColumn("role", F.lit("train"))
    fits = written(fit_grid(folded.unionByName(refit).filter("role = 'train'"), grid, gammas, n), "margins")
    judged = written(decisions(folded.filter("role = 'test'"), fits.filter(F.col("fold") != REFIT), ["label"], n), "judged")
    # the logistic curve keeps the order of decisions and lies between 0 and 1
    as_scores = judged.select(*KEY, "C", "gamma", F.col("label").cast("int").alias("y_true"), chance(F.col("decision"), F.lit(-1.0), F.lit(0.0)).alias("y_prob"))
    mean = M.roc_auc(as_scores, [*KEY, "C", "gamma"]).groupBy("Stock", "C", "gamma").agg(F.avg("auc_roc").alias("auc"))
    place = F.array_position(F.array(*[F.lit(str(g)) for g in gammas]), F.col("gamma"))
    best = mean.groupBy("Stock").agg(F.min_by(F.struct("C", "gamma", "auc"), F.struct(-F.round("auc", 9), F.col("C"), place)).alias("b"))
    best = written(best.select("Stock", F.col("b.C").alias("best_C"), F.col("b.gamma").alias("best_gamma"), half_even(F.col("b.auc")).alias("best_cv_auc")), "best")
    chosen = lambda df: df.join(best, "Stock").filter("C = best_C and gamma = best_gamma").select(*df.columns)
    curve = written(calibrate(chosen(judged)), "sigmoids")
    scored = decisions(rows.withColumn("fold", F.lit(REFIT)), chosen(fits.filter(F.col("fold") == REFIT)), ["Target_Date", "split", "Target_Label"], n)
    out = scored.join(curve, "Stock").select(
        "Stock", "Target_Date", "split", "Target_Label", F.lit(model).alias("model"), chance(F.col("decision"), F.col("a"), F.col("b")).alias("y_prob")
    )
    return out, best
