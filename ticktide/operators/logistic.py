"""Logistic regression of groups of any size by summed moments.

Every Newton step is one aggregate for all groups and folds: tasks add up loss, slope and curvature of the rows they
hold, a tree of sums brings them together, and one row per group and fold moves its weights. No group is gathered; the
number of jobs is the number of steps, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions import vectors as V
from ticktide.operators.panel import join_spread
from ticktide.session import written

KEY = ["Stock", "fold"]
STATE = "Stock string, fold int, b array<double>, best array<double>, move array<double>, loss double, size double, done boolean"
SUMS = "Stock string, fold int, task int, total double, loss double, slope array<double>, curve array<double>"
#: Sums of one group and fold that one task adds up.
FAN_IN = 64
BROADCAST_GROUPS = 2_000
CLOSE = 1e-12


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of every run of rows of one group and fold; rows stand in order of both."""
    task = TaskContext.get().partitionId()
    now, sums = None, None
    line = lambda: pd.DataFrame({"Stock": [now[0]], "fold": [now[1]], "task": [task], "total": [sums[0]], "loss": [sums[1]], "slope": [sums[2]], "curve": [sums[3].ravel()]})
    for frame in frames:
        for key, own in frame.groupby(KEY, sort=False):
            x = np.column_stack([np.stack(own["x"].to_numpy()), np.ones(len(own))])
            b, y, w = np.asarray(own["b"].iloc[0], float), own["label"].to_numpy(), own["weight"].to_numpy()
            margin = x @ b
            p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            new = (w.sum(), w @ np.logaddexp(0.0, -(2 * y - 1) * margin), x.T @ (w * (p - y)), (x * (w * p * (1 - p))[:, None]).T @ x)
            if now is not None and key != now:
                yield line()
                sums = None
            now, sums = key, new if sums is None else tuple(a + c for a, c in zip(sums, new))
    if sums is not None:
        yield line()


def _together(own: pd.DataFrame) -> pd.DataFrame:
    out = own.iloc[[0]].copy()
    out["total"], out["loss"] = own["total"].sum(), own["loss"].sum()
    for c in ("slope", "curve"):
        out[c] = [np.sum(np.stack(own[c].to_numpy()), axis=0)]
    return out


def _stepper(reg: float):
    def step(state: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        """Take the step that was tried if the loss fell, and try the next; else halve it."""
        if state.empty or sums.empty:
            return state
        s, own = state.iloc[0].to_dict(), _together(sums).iloc[0]
        b = np.asarray(s["b"], float)
        ridge = np.full(len(b), reg)
        ridge[-1] = 0.0  # the last weight is the intercept
        loss = own["loss"] / own["total"] + ridge @ (b * b) / 2
        if s["loss"] is None or np.isnan(s["loss"]) or loss <= s["loss"]:
            fell = np.inf if s["loss"] is None or np.isnan(s["loss"]) else s["loss"] - loss
            slope = own["slope"] / own["total"] + ridge * b
            curve = own["curve"].reshape(len(b), len(b)) / own["total"] + np.diag(ridge + 1e-9)
            move = np.linalg.solve(curve, slope)
            s |= {"best": b, "loss": loss, "move": move, "size": 1.0, "b": b - move, "done": bool(fell < CLOSE)}
        else:
            size = s["size"] / 2
            s |= {"size": size, "b": np.asarray(s["best"]) - size * np.asarray(s["move"]), "done": bool(size < 1e-6)}
        return pd.DataFrame([s])[[c.split()[0] for c in STATE.split(", ")]]

    return step


def fit(rows: DataFrame, reg: float = 0.01, steps: int = 60) -> DataFrame:
    """(Stock, fold, weights) of every group and fold; ``rows`` holds KEY, label, weight, x and a unique ``key``."""
    given = written(rows.select(*KEY, "label", "weight", "x", "key").sortWithinPartitions(*KEY), "moments_of")
    zeros = F.array_repeat(F.lit(0.0), F.col("dim") + 1)
    none = F.lit(None).cast("double")
    state = given.groupBy(*KEY).agg(F.max(F.size("x")).alias("dim")).select(
        *KEY, zeros.alias("b"), zeros.alias("best"), zeros.alias("move"), none.alias("loss"), F.lit(1.0).alias("size"), F.lit(False).alias("done")
    )
    state = written(state, "weights")
    few = state.count() <= BROADCAST_GROUPS
    tasks = given.rdd.getNumPartitions()
    for _ in range(steps):
        open_ = state.filter("not done").select(*KEY, "b")
        joined = given.join(F.broadcast(open_), KEY) if few else join_spread(given, open_, KEY, F.col("key")).sortWithinPartitions(*KEY)
        sums = joined.select(*KEY, "label", "weight", "x", "b").mapInPandas(_moments, SUMS)
        left = tasks if few else max(tasks, int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        while left > FAN_IN:
            sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy(*KEY, "task").applyInPandas(_together, SUMS)
            left = -(-left // FAN_IN)
        moved = state.filter("not done").groupBy(*KEY).cogroup(sums.groupBy(*KEY)).applyInPandas(_stepper(reg), STATE)
        state = written(state.filter("done").unionByName(moved), "weights")
        if not state.filter("not done").limit(1).count():
            break
    return state.select(*KEY, F.col("best").alias("weights"))


def chance(weights: Column, x: Column) -> Column:
    """Chance of label 1; ``weights`` end with the intercept."""
    return F.lit(1.0) / (F.exp(-V.dot(weights, F.concat(x, F.array(F.lit(1.0))))) + 1.0)


def cross_scores(folded: DataFrame, reg: float = 0.01, steps: int = 60) -> DataFrame:
    """Stock, fold, y_true and y_prob of every row of ``folded`` (Stock, fold, key, label, weight, x), by the weights of the other folds."""
    of = written(folded.select("Stock", "key", "label", "weight", "x", F.col("fold").alias("own_fold")), "folds")
    every = of.select("own_fold").distinct().agg(F.sort_array(F.collect_set("own_fold"))).scalar()  # a few folds
    fits = fit(of.withColumn("fold", F.explode(every)).filter("fold <> own_fold"), reg, steps)
    rows = of.withColumnRenamed("own_fold", "fold")
    joined = rows.join(F.broadcast(fits), KEY) if fits.count() <= BROADCAST_GROUPS else join_spread(rows, fits, KEY, F.col("key"))
    return joined.select(*KEY, F.col("label").cast("int").alias("y_true"), chance(F.col("weights"), F.col("x")).alias("y_prob"))
