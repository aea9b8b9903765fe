"""Exact nearest neighbours by cosine in groups of any size, without all pairs.

Rows are unit vectors, so the cosine distance falls and rises with the straight distance, for which the triangle
inequality holds. A large group gets pivots; every row belongs to the cell of its nearest pivot, and a cell's radius is
the largest distance of its rows from the pivot. A row first looks through its own cell; the k-th distance found there
rules out all cells whose pivot is farther away than that distance and the cell's radius together. It goes on to the
others only. Cells are cut into units of bounded size, and rows look from unit to unit, so no task holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.session import written

#: Rows of a unit, and of a cell as far as the number of pivots allows.
UNIT_ROWS = 2000
PIVOTS = 256
#: Pivots of all groups together; beyond them groups of one cell are cut into units only.
ALL_PIVOTS = 20_000
STRIP = 1024
#: Distances differ by rounding only below this.
SLACK = 1e-6
DIGITS = 9

FOUND = "grp string, key string, y int, fold int, cand string, cand_y int, dist double"
NONE = {"grp": object, "key": object, "y": int, "fold": int, "cand": object, "cand_y": int, "dist": float}


def _best(k: int):
    """The ``k`` best of a unit for each row that asks, outside the row's own fold: by cosine distance, then key."""

    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or base.empty:
            return pd.DataFrame(columns=list(NONE)).astype(NONE)
        q, b = np.stack(queries["u"].to_numpy()), np.stack(base["base_u"].to_numpy())
        base_key, base_y, base_fold = (base[f"base_{c}"].to_numpy() for c in ("key", "y", "fold"))
        by_key = np.empty(len(base), dtype=int)
        by_key[np.argsort(base_key, kind="stable")] = np.arange(len(base))
        last = min(k, len(base)) - 1
        out = []
        for at in range(0, len(q), STRIP):
            rows = slice(at, at + STRIP)
            dist = np.round(1.0 - q[rows] @ b.T, DIGITS)
            dist[queries["fold"].to_numpy()[rows][:, None] == base_fold[None, :]] = np.inf
            edge = np.partition(dist, last, axis=1)[:, last]
            i, j = np.nonzero((dist <= edge[:, None]) & np.isfinite(dist))
            order = np.lexsort((by_key[j], dist[i, j], i))
            i, j = i[order], j[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[kept], j[kept]
            mine = queries.iloc[at + i][["grp", "key", "y", "fold"]].reset_index(drop=True)
            out.append(mine.assign(cand=base_key[j], cand_y=base_y[j], dist=dist[i, j]))
        return pd.concat(out)[list(NONE)].astype(NONE)

    return run


def _looked_up(asks: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """FOUND rows for ``asks``: rows with the unit ``there`` that they look into."""
    pairs = asks.select(F.col("grp").alias("of"), F.col("unit").alias("from_unit"), F.col("there").alias("to_unit")).distinct()
    base = rows.select(*[F.col(c).alias(f"base_{c}") for c in ("grp", "key", "y", "fold", "u", "unit")])
    base = base.join(pairs, (F.col("base_grp") == F.col("of")) & (F.col("base_unit") == F.col("to_unit")))
    given = base.groupBy("base_grp", "from_unit", "to_unit")
    asked = asks.select("grp", "key", "y", "fold", "u", F.col("unit").alias("ask_unit"), "there").groupBy("grp", "ask_unit", "there")
    return given.cogroup(asked).applyInPandas(_best(k), FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("grp", "key").orderBy("dist", "cand")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest(rows: DataFrame, k: int = 5, unit_rows: int = UNIT_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """grp, key, y, fold, cand, cand_y, dist and place of the ``k`` nearest rows of every row outside its own fold.

    ``rows`` holds grp, key (unique in its group), y, fold and ``u``, vectors of length one or zero.
    """
    given = written(rows.select("grp", "key", "y", "fold", "u"), "vectors")
    sizes = given.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > unit_rows)
    number = F.least(F.ceil(F.col("n") / unit_rows), F.lit(pivots)).cast("int")
    wanted = written(sizes.select("grp", number.alias("pivots")), "large_groups")
    upto = F.sum("pivots").over(Window.orderBy("grp"))  # a row per large group
    wanted = wanted.withColumn("upto", upto).filter(F.col("upto") <= ALL_PIVOTS).select("grp", "pivots")
    drawn = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("key"), "key"))
    chosen = given.join(F.broadcast(wanted), "grp").withColumn("pivot", drawn).filter(F.col("pivot") <= pivots).filter("pivot <= pivots")
    points: dict[str, np.ndarray] = {}
    for r in chosen.select("grp", "pivot", "u").orderBy("grp", "pivot").collect():  # at most ALL_PIVOTS rows
        points.setdefault(r["grp"], []).append(r["u"])
    points = {g: np.array(p, float) for g, p in points.items()}

    def far(u: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((u * u).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * u @ p.T, 0.0))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, away = np.zeros(len(frame), int), np.zeros(len(frame))
            for g, at in frame.groupby("grp").indices.items():
                if g in points:
                    d = far(np.stack(frame["u"].to_numpy()[at]), points[g])
                    cell[at], away[at] = d.argmin(axis=1), d.min(axis=1)
            yield frame.assign(cell=cell, away=away)

    placed = written(given.mapInPandas(place, "grp string, key string, y int, fold int, u array<double>, cell int, away double"), "cells")
    cells = placed.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    units = F.ceil(F.col("n") / unit_rows).cast("int")
    before = F.coalesce(F.sum("units").over(Window.partitionBy("grp").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = written(cells.select("grp", "cell", "radius", units.alias("units")).withColumn("first", before), "cell_units")
    unit = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("units"))).cast("int").alias("unit")
    in_units = written(placed.join(cells, ["grp", "cell"]).select("grp", "key", "y", "fold", "u", "cell", unit), "units")
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("units") - 1)).alias("there")

    at_home = in_units.join(cells, ["grp", "cell"]).select("grp", "key", "y", "fold", "u", "unit", every)
    first = written(_merged(_looked_up(at_home, in_units, k), k), "near_home")
    if not points:
        return first
    bound = first.groupBy("grp", "key").agg(F.count("*").alias("m"), F.max("dist").alias("kth"))
    asks = in_units.filter(F.col("grp").isin(list(points))) if len(points) <= 1000 else in_units
    asks = asks.join(bound, ["grp", "key"], "left").select("grp", "key", "y", "fold", "u", "cell", "unit", F.when(F.col("m") >= k, F.col("kth")).alias("kth"))
    # at most ALL_PIVOTS rows
    radii: dict[str, np.ndarray] = {g: np.full(len(p), -np.inf) for g, p in points.items()}
    for r in cells.filter(F.col("grp").isin(list(points))).select("grp", "cell", "radius").collect() if len(points) <= 1000 else cells.join(F.broadcast(wanted), "grp").collect():
        radii[r["grp"]][r["cell"]] = r["radius"]

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells_of = np.empty(len(frame), object)
            for i in range(len(frame)):
                cells_of[i] = []
            for g, at in frame.groupby("grp").indices.items():
                if g not in points:
                    continue
                d = far(np.stack(frame["u"].to_numpy()[at]), points[g])
                kth = frame["kth"].to_numpy()[at].astype(float)
                reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(2 * kth, 0.0)) + SLACK)  # of distance 1 - cosine
                own = frame["cell"].to_numpy()[at]
                maybe = (d - radii[g][None] <= reach[:, None]) & np.isfinite(radii[g])[None]
                maybe[np.arange(len(at)), own] = False
                for i, row in zip(at, maybe):
                    cells_of[i] = np.flatnonzero(row).astype(int).tolist()
            yield frame.drop(columns=["kth", "cell"]).assign(cells=cells_of)

    on = asks.mapInPandas(others, "grp string, key string, y int, fold int, u array<double>, unit int, cells array<int>")
    on = written(on.filter(F.size("cells") > 0), "asks")
    away_asks = on.withColumn("cell", F.explode("cells")).join(cells, ["grp", "cell"]).select("grp", "key", "y", "fold", "u", "unit", every)
    return _merged(first.drop("place").unionByName(_looked_up(away_asks, in_units, k)), k)
