"""A small recurrent net per symbol, with its history of epochs: all symbols in one grouped job.

One step of a long short-term memory cell from an empty state (the sequence before a day is one vector), a dense layer
and a logistic output, fitted by Adam on minibatches with balanced class weights. The rate halves when the validation
loss stands still, the fit stops early, and the weights of the best epoch are kept. Groups hold one symbol's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.operators.trees import drawing, log_loss

EPOCH = "struct<epoch:int,loss:double,val_loss:double,accuracy:double,val_accuracy:double>"
NET = f"Stock string, inputs int, weights array<double>, history array<{EPOCH}>"


@dataclass(frozen=True)
class Training:
    units: int = 32
    dense: int = 16
    rate: float = 0.0005
    epochs: int = 300
    batch: int = 8
    patience: int = 40
    slow_patience: int = 15
    least_rate: float = 1e-6
    l2: float = 1e-4
    dropout: float = 0.3


class Net:
    """Weights in one flat vector: input, output and cell gate, dense layer, output."""

    def __init__(self, inputs: int, how: Training):
        u, d = how.units, how.dense
        self.how, self.shapes = how, [(inputs + 1, 3 * u), (u + 1, d), (d + 1, 1)]
        self.size = sum(a * b for a, b in self.shapes)

    def first(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for a, b in self.shapes:
            w = rng.normal(size=(a, b)) * np.sqrt(2.0 / (a + b))
            w[-1] = 0.0  # the last row is the intercept
            parts.append(w.ravel())
        return np.concatenate(parts)

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append(flat[at : at + a * b].reshape(a, b))
            at += a * b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray, masks: Sequence[np.ndarray] = (1.0, 1.0)) -> tuple:
        gates, dense, last = self.parts(flat)
        u, one = self.how.units, np.ones((len(x), 1))
        x1 = np.hstack([x * masks[0], one])
        a = x1 @ gates
        i, o, g = 1 / (1 + np.exp(-a[:, :u])), 1 / (1 + np.exp(-a[:, u : 2 * u])), np.tanh(a[:, 2 * u :])
        c = np.tanh(i * g)
        h1 = np.hstack([o * c, one])
        d = np.maximum(h1 @ dense, 0.0)
        d1 = np.hstack([d * masks[1], one])
        return (d1 @ last)[:, 0], (x1, i, o, g, c, h1, d, d1, masks)

    def slope(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, masks: Sequence[np.ndarray]) -> np.ndarray:
        """Derivative of the mean weighted loss and of the ridge on all but the intercepts."""
        gates, dense, last = self.parts(flat)
        odds, (x1, i, o, g, c, h1, d, d1, masks) = self.forward(flat, x, masks)
        out = (w * (1 / (1 + np.exp(-odds)) - y) / len(x))[:, None]
        d_last = d1.T @ out
        back = (out @ last[:-1].T) * masks[1] * (d > 0)
        d_dense = h1.T @ back
        h = back @ dense[:-1].T
        cell = h * o * (1 - c * c)
        d_gates = x1.T @ np.hstack([cell * g * i * (1 - i), h * c * o * (1 - o), cell * i * (1 - g * g)])
        grads = [d_gates, d_dense, d_last]
        for grad, w_ in zip(grads[:2], (gates, dense)):
            grad[:-1] += 2 * self.how.l2 * w_[:-1]
        return np.concatenate([x.ravel() for x in grads])


def trained(x: np.ndarray, y: np.ndarray, w: np.ndarray, val_x: np.ndarray, val_y: np.ndarray, how: Training, *name: object) -> tuple[np.ndarray, list[dict]]:
    """Weights of the epoch of the lowest validation loss (of the last, without validation rows) and all epochs."""
    rng = drawing(*name)
    net = Net(x.shape[1], how)
    flat = net.first(rng)
    mean, square, steps, rate = np.zeros(net.size), np.zeros(net.size), 0, how.rate
    best, least, waited, slow, history = flat, np.inf, 0, 0, []
    share = lambda odds, truth: float(((odds >= 0) == (truth > 0)).mean()) if len(truth) else None
    for epoch in range(1, how.epochs + 1):
        order = rng.permutation(len(x))
        for first in range(0, len(x), how.batch):
            own = order[first : first + how.batch]
            masks = [(rng.random((len(own), n)) >= how.dropout) / (1 - how.dropout) for n in (x.shape[1], how.dense)]
            slope = net.slope(flat, x[own], y[own], w[own], masks)
            steps += 1
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            flat = flat - rate * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.999**steps)) + 1e-7)
        odds = net.forward(flat, x)[0]
        val = net.forward(flat, val_x)[0] if len(val_x) else np.zeros(0)
        val_loss = log_loss(val_y, val) if len(val_x) else None
        history.append({"epoch": epoch, "loss": log_loss(y, odds), "val_loss": val_loss, "accuracy": share(odds, y), "val_accuracy": share(val, val_y)})
        if val_loss is None:
            best = flat
        elif val_loss < least:
            best, least, waited, slow = flat, val_loss, 0, 0
        else:
            waited, slow = waited + 1, slow + 1
            if slow >= how.slow_patience:
                rate, slow = max(rate / 2, how.least_rate), 0
            if waited >= how.patience:
                break
    return best, history


def fit(rows: DataFrame, how: Training = Training(), seed: int = 42) -> DataFrame:
    """NET rows of every symbol; ``rows`` holds Stock, Target_Date, split, label, weight and x."""

    def of_symbol(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("Target_Date", kind="stable")
        train, val = own[own["split"] == "train"], own[own["split"] == "val"]
        if train.empty:
            return pd.DataFrame(columns=["Stock", "inputs", "weights", "history"])
        x = np.stack(train["x"].to_numpy()).astype(float)
        val_x = np.stack(val["x"].to_numpy()).astype(float) if len(val) else np.zeros((0, x.shape[1]))
        stock = own["Stock"].iloc[0]
        best, history = trained(x, train["label"].to_numpy(), train["weight"].to_numpy(), val_x, val["label"].to_numpy(), how, seed, stock)
        return pd.DataFrame({"Stock": [stock], "inputs": [x.shape[1]], "weights": [best], "history": [history]})

    return rows.select("Stock", "Target_Date", "split", "label", "weight", "x").groupBy("Stock").applyInPandas(of_symbol, NET)


def score(rows: DataFrame, nets: DataFrame, keep: Sequence[str], how: Training = Training(), model: str = "lstm") -> DataFrame:
    """Stock, ``keep``, model and y_prob of every row whose symbol has a net, by one join of the two."""
    given = rows.select("Stock", *keep, "x")
    schema = given.drop("x").schema.add("model", "string").add("y_prob", "double")

    def of_symbol(own: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
        if own.empty or net.empty:
            return pd.DataFrame(columns=schema.names)
        odds = Net(int(net["inputs"].iloc[0]), how).forward(np.asarray(net["weights"].iloc[0]), np.stack(own["x"].to_numpy()).astype(float))[0]
        return own.drop(columns="x").assign(model=model, y_prob=1 / (1 + np.exp(-np.clip(odds, -500, 500))))[schema.names]

    return given.groupBy("Stock").cogroup(nets.select("Stock", "inputs", "weights").groupBy("Stock")).applyInPandas(of_symbol, schema)


def history(nets: DataFrame) -> DataFrame:
    """Long form (Stock, metric, epoch, value) of every epoch of every net."""
    each = nets.select("Stock", F.inline("history"))
    return each.unpivot(["Stock", "epoch"], ["loss", "val_loss", "accuracy", "val_accuracy"], "metric", "value")
