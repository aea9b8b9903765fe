"""Embedding whitening by weighted multiplicity covariance.

Rows of one vector are grouped first; the distinct vectors carry their count (or one) as the weight of the fit. Sums of
whole numbers are exact; every vector is centred as (n * x - S) / n, from exact whole numbers, before its outer product
enters the covariance, which tasks add up as weighted matrix products. Partial sums are merged in a tree of FAN_IN, so
no task holds more than that many matrices. Eigenvectors of the one dim x dim matrix are found on the driver; each
distinct vector is projected once and joined back to its rows, the vectors of many rows by a broadcast that their number
bounds, the others by a shuffle.

A NULL vector and one with a NULL or non-finite entry take no part; a NULL vec_id does. Repeated rows and ids count each.
Vectors of different lengths have no common covariance: each length is a fit of its own, up to LENGTHS lengths; more are
an error. Empty vectors have no components. Where nothing varies, eigenvalues are rounding noise: such components have
``whitened`` NULL and do not count for ``identity_error``; ``explained`` is NULL if no component varies. Other columns
of the input are not read. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.session import written

COMPONENTS = 32
LENGTHS = 64
FAN_IN = 32
#: A vector of more than this share of the rows is broadcast: there are fewer than 1 / HOT of them.
HOT = 0.001
WEIGHTS = ("count", "one")


def fixed_point(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of every entry c, of the vectors that take part."""
    infinite = F.lit(float("inf"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    return vectors.filter(F.col("embedding").isNotNull() & sound).select(
        "vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x")
    )


@dataclass
class Fit:
    n: int
    sums: np.ndarray
    basis: np.ndarray | None = None  # a column per component, over the root of its eigenvalue; NaN where nothing varies
    explained: list[float | None] | None = None
    identity_error: float = 0.0


def _matrices(batch: pa.RecordBatch, values: str, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length in a batch."""
    lists = batch.column(values)
    sizes = lists.value_lengths().to_numpy()
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(dim), rows, flat.astype(kind).reshape(len(rows), int(dim))


def _added(tables: Iterator[np.ndarray]) -> np.ndarray:
    total = None
    for own in tables:
        if total is not None and own.dtype == np.int64 and np.abs(total.astype(float)).max() + np.abs(own.astype(float)).max() >= 2.0**63:
            raise OverflowError("sums of the vectors do not fit 64 bits")
        total = own if total is None else total + own
    return total


def _totals(distinct: DataFrame, values: str, kind: str, own: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Per length, the sum of ``own(length, vectors, weights)`` over all rows of ``distinct``, a written table."""
    of = np.int64 if kind == "long" else np.float64

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for dim, rows, x in _matrices(batch, values, of):
                new = own(dim, x, weights[rows])
                sums[dim] = _added(iter([sums[dim], new])) if dim in sums else new
        task = TaskContext.get().partitionId()
        yield from (_line(dim, task, total) for dim, total in sums.items())

    def _line(dim: int, task: int, total: np.ndarray) -> pa.RecordBatch:
        cells = [pa.array([dim], pa.int32()), pa.array([task], pa.int32()), pa.array([total.ravel()], pa.list_(pa.from_numpy_dtype(of)))]
        return pa.RecordBatch.from_arrays(cells, ["dim", "task", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        total = _added(np.asarray(v.values) for v in group["sums"])
        return pa.Table.from_batches([_line(group["dim"][0].as_py(), group["task"][0].as_py(), total)])

    schema = f"dim int, task int, sums array<{kind}>"
    merged = distinct.select(values, "weight").mapInArrow(parts, schema)
    tasks = distinct.rdd.getNumPartitions()
    while tasks > 1:
        merged = merged.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("dim", "task").applyInArrow(merge, schema)
        tasks = -(-tasks // FAN_IN)
    return {r["dim"]: np.array(r["sums"], of) for r in merged.collect()}  # a row per length


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums; of Python numbers where 64 bits do not do."""
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) < 2.0**62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Sums and scaled eigenvectors per length, from a written table of distinct ``x`` with ``weight``."""
    lengths = [r["n"] for r in distinct.select(F.size("x").alias("n")).distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")

    def first(dim: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        if float(np.abs(x).max(initial=1)) * float(w.sum()) >= 2.0**62:
            raise OverflowError("sums of the vectors do not fit 64 bits")
        return np.append(w @ x, w.sum())

    fits = {dim: Fit(int(s[-1]), s[:-1]) for dim, s in _totals(distinct, "x", "long", first).items() if dim}

    def outer(dim: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        if not dim:
            return np.zeros(0)
        centred = _exact(x, fits[dim].n, fits[dim].sums).astype(float) / fits[dim].n
        return (centred.T * w) @ centred

    for dim, total in _totals(distinct, "x", "double", outer).items():
        if not dim:
            continue
        values, vectors = np.linalg.eigh(total.reshape(dim, dim) / fits[dim].n)
        values, vectors = np.maximum(values[::-1], 0.0)[:components], vectors[:, ::-1][:, :components]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        varies = values > values.max() * dim * np.finfo(float).eps
        trace = float(np.trace(total.reshape(dim, dim)) / fits[dim].n)
        with np.errstate(divide="ignore", invalid="ignore"):
            fits[dim].basis = np.where(varies, vectors / np.sqrt(values), np.nan)
        fits[dim].explained = [float(v) / trace if trace > 0 else None for v in values]
    return fits


def _projected(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """x, rows, weight, deviation and whitened of every distinct vector."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _matrices(batch, "x", np.int64):
                if not dim:
                    continue
                own = fits[dim]
                exact = _exact(x, own.n, own.sums)
                if exact.dtype != object and (exact.astype(float) ** 2).sum(axis=1).max() >= 2.0**62:
                    exact = exact.astype(object)
                deviation = [Decimal(int(d)) for d in (exact * exact).sum(axis=1)]
                white = (exact.astype(float) / own.n) @ own.basis
                flat = pa.array(white.ravel(), mask=np.isnan(white).ravel())
                at = np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1]
                take = pa.array(rows)
                cells = [*(batch.column(c).take(take) for c in ("x", "rows", "weight")), pa.array(deviation, pa.decimal128(38, 0)),
                         pa.ListArray.from_arrays(pa.array(at), flat)]
                yield pa.RecordBatch.from_arrays(cells, ["x", "rows", "weight", "deviation", "whitened"])

    return distinct.select("x", "rows", "weight").mapInArrow(
        project, "x array<long>, rows long, weight long, deviation decimal(38,0), whitened array<double>"
    )


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component.

    ``vectors`` holds vec_id and whole numbers ``x``; with ``weights`` "one" each distinct vector counts once in the fit.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights is one of {WEIGHTS}")
    rows = written(vectors.select("vec_id", "x"), "vectors")
    weight = F.count("*") if weights == "count" else F.lit(1).cast("long")
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("rows"), weight.alias("weight")), "distinct")
    fits = fit(distinct, components)
    white = written(_projected(distinct, fits), "whitened")

    def outer(size: int, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
        w = np.nan_to_num(w)
        return (w.T * weight) @ w

    for dim, own in fits.items():
        size = own.basis.shape[1]
        total = _totals(white.filter(F.size("x") == dim), "whitened", "double", outer)[size].reshape(size, size) / own.n
        varies = ~np.isnan(own.basis).any(axis=0)
        error = np.abs(total - np.diag(varies.astype(float)))[np.ix_(varies, varies)]
        own.identity_error = float(error.max(initial=0.0))

    n_rows = rows.count()
    hot = F.col("rows") > n_rows * HOT
    several = F.broadcast(white.filter(hot).select("x", "deviation", "whitened"))
    few = white.filter(~hot).select("x", "deviation", "whitened")
    joined = rows.join(several, "x").unionByName(rows.join(several.select("x"), "x", "left_anti").join(few, "x"))
    return joined.select(
        "vec_id", "deviation", F.size("x").alias("dim"), F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), _of_fit(fits, lambda f: F.lit(f.n), "long").alias("n"), "deviation", "whitened",
        _of_fit(fits, lambda f: F.get(F.array(*map(F.lit, f.explained)), F.col("place")), "double").alias("explained"),
        _of_fit(fits, lambda f: F.lit(f.identity_error), "double").alias("identity_error"),
    )


def _of_fit(fits: dict[int, Fit], value: Callable[[Fit], Column], kind: str) -> Column:
    found = F.lit(None).cast(kind)
    for dim, own in fits.items():
        found = F.when(F.col("dim") == dim, value(own).cast(kind)).otherwise(found)
    return found
