"""Hard negatives by an inverted multi-index.

Two codebooks, one for each half of the dimensions, are fitted on SAMPLE rows; every row belongs to the cell of its two
nearest codewords. For an anchor q a codeword c with radius r (the largest distance of any row's half from it, over all
rows) has the half-score bound q.c + |q| r, and the sum of two bounds no score in the cell can pass. The multi-sequence
heap visits the cells of an anchor in falling order of that sum, so the top of the heap bounds all that is unvisited.

Search goes in rounds, each a join of the cells' rows with the anchors that ask for them, over GROWTH times as many rows
as the one before. Cells are cut into bins of some BIN rows and anchors into chunks of some CHUNK, so every task's group
is bounded. First every anchor looks for its positives, the best rows of its label, until the last of them beats the
bound. Each positive opens a window of scores, ``low`` to ``high`` hundredths of its own. Then the anchor starts again
with its windows, passing over cells that lie wholly above or below them, until each window is certified: filled above
the bound, or wholly above it. Ties at the bound go on, as an unvisited row may have the smaller id. The result is exact.

A row whose id, label or vector is NULL, or whose vector holds a NULL or non-finite entry, takes no part; vectors of
different lengths are no pair. Of several rows of one anchor id the greatest (label, vector) asks, and no row of the
anchor's id is its positive. An anchor without positives, and a window without rows, give nothing. Rows count each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.session import written

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Rows that the codebooks are fitted on. They steer the order of visits only; every row is indexed and bounded.
SAMPLE = 4096
CODEWORDS = 16
ITERATIONS = 12
BIN = 4096
CHUNK = 2048
FIRST_ROWS, GROWTH = 4096, 8
STRIP = 256


def whole_components(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and vec = floor(scale * x) of every component x, of the rows that take part."""
    infinite = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"),
    )


def _padded(lists: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of ``dim`` numbers, zeros behind shorter ones, and their lengths."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b``; exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    raise OverflowError("scores do not fit 64 bits")


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)


def codebook(x: np.ndarray, codewords: int = CODEWORDS, iterations: int = ITERATIONS) -> np.ndarray:
    """Codewords of whole numbers, by means of the rows nearest to each, from the first different rows on."""
    _, first = np.unique(x, axis=0, return_index=True)
    book = x[np.sort(first)[:codewords]].astype(float)
    if not len(book):
        return np.zeros((1, x.shape[1]))
    for _ in range(iterations):
        at = _nearest(x.astype(float), book)
        for k in np.unique(at):
            book[k] = x[at == k].mean(axis=0)
    return np.round(book)


@dataclass
class MultiIndex:
    """Codebooks, radii and the number of rows per cell: what an anchor needs to order its cells."""

    dim: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    counts: np.ndarray = None  # codewords x codewords

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.dim // 2].astype(float), x[:, self.dim // 2 :].astype(float)

    def visit(self, query: np.ndarray, passed: int, rows: int, least: int | None, most: int | None) -> tuple[list[int], int, int | None]:
        """Cells after the first ``passed`` until they hold ``rows`` rows, how many are passed then, and the bound of the others.

        Cells whose scores all lie below ``least`` or above ``most`` are passed without a visit.
        """
        bounds, centres, slack = [], [], 1.0
        for half, book, radius in zip(self.halves(query[None, :]), self.books, self.radii):
            centre = book @ half[0]
            reach = np.sqrt((half[0] ** 2).sum()) * radius
            slack += 1e-9 * (np.abs(centre).max(initial=0) + np.max(reach, where=np.isfinite(reach), initial=0))
            bounds.append(centre + reach)
            centres.append((centre - reach, reach))
        order = [np.argsort(-b, kind="stable") for b in bounds]
        upper = lambda i, j: bounds[0][order[0][i]] + bounds[1][order[1][j]] + slack
        heap, met = [(-upper(0, 0), 0, 0)], {(0, 0)}
        cells, n, held = [], 0, 0
        while heap:
            bound = -heap[0][0]
            if not np.isfinite(bound) or (least is not None and bound < least):
                return cells, n, None  # what is left is empty, or below all windows
            if held >= rows:
                return cells, n, int(np.ceil(bound))
            _, i, j = heapq.heappop(heap)
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < len(order[0]) and step[1] < len(order[1]) and step not in met:
                    met.add(step)
                    heapq.heappush(heap, (-upper(*step), *step))
            n += 1
            a, b = order[0][i], order[1][j]
            if n > passed and self.counts[a, b] and not (most is not None and centres[0][0][a] + centres[1][0][b] - slack > most):
                cells.append(int(a * len(self.books[1]) + b))
                held += int(self.counts[a, b])
        return cells, n, None


def build(rows: DataFrame, codewords: int = CODEWORDS, sample: int = SAMPLE, bin_rows: int = BIN) -> tuple[MultiIndex, DataFrame, DataFrame]:
    """The index, its cells (cell, first_bin, bins: at most codewords squared rows) and all rows with their ``bin``."""
    dim = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    drawn = rows.select("vec").orderBy(F.xxhash64("vec_id", "vec"), "vec").limit(sample).toArrow()["vec"]
    x, _ = _padded(drawn, dim)
    index = MultiIndex(dim, (codebook(x[:, : dim // 2], codewords), codebook(x[:, dim // 2 :], codewords)))
    wide = len(index.books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = index.halves(_padded(batch.column("vec"), dim)[0])
            at = [_nearest(h, book) for h, book in zip(halves, index.books)]
            far = [np.sqrt(((h - book[a]) ** 2).sum(axis=1)) for h, book, a in zip(halves, index.books, at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((at[0] * wide + at[1]).astype(np.int32)), *map(pa.array, far)], [*batch.schema.names, "cell", "far_1", "far_2"]
            )

    placed = rows.select("vec_id", "label", "vec").mapInArrow(assign, "vec_id long, label long, vec array<long>, cell int, far_1 double, far_2 double")
    placed = written(placed, "cells")
    # at most codewords squared rows
    held = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_1").alias("a"), F.max("far_2").alias("b")).orderBy("cell").collect()
    index.radii = tuple(np.full(len(book), -np.inf) for book in index.books)
    index.counts = np.zeros((len(index.books[0]), wide), np.int64)
    listed, first = [], 0
    for r in held:
        i, j = divmod(r["cell"], wide)
        index.counts[i, j] = r["n"]
        index.radii[0][i], index.radii[1][j] = max(index.radii[0][i], r["a"]), max(index.radii[1][j], r["b"])
        bins = -(-r["n"] // bin_rows)
        listed.append((r["cell"], first, bins))
        first += bins
    cells = F.broadcast(rows.sparkSession.createDataFrame(listed, "cell int, first_bin int, bins int"))
    nth = F.pmod(F.monotonically_increasing_id(), F.col("bins"))  # rows alike are dealt out like all others
    binned = placed.join(cells, "cell").select((F.col("first_bin") + nth).cast("int").alias("bin"), "vec_id", "label", "vec")
    return index, cells, written(binned, "bins")


_FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and most whole number s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _search(own: pa.Table, asked: pa.Table, dim: int, k: int, low: int | None, high: int | None) -> pa.Table:
    """The best ``k`` of a bin for every anchor: of its label, or with ``low`` and ``high`` of other labels in each window."""
    if not own.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    own = own.sort_by("vec_id")
    ids, labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
    x, sizes = _padded(own["vec"], dim)
    queries, lengths = _padded(asked["vec"], dim)
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    anchors, own_label = asked["anchor_id"].to_numpy(), asked["label"].to_numpy()
    windows = asked["windows"].to_pylist()
    for first in range(0, len(anchors), STRIP):
        scores = _scores(queries[first : first + STRIP], x)
        for k_anchor, s in enumerate(scores, first):
            alike = labels == own_label[k_anchor]
            fits = sizes == lengths[k_anchor]
            if low is None:
                at = np.flatnonzero(fits & alike & (ids != anchors[k_anchor]))
                if len(at) > k:
                    at = at[s[at] >= np.partition(s[at], -k)[-k]]
                at = at[np.argsort(-s[at], kind="stable")][:k]
                out.append((anchors[k_anchor], 0, s[at], ids[at]))
                continue
            limits = [_window(w["score"], low, high) for w in windows[k_anchor]]
            at = np.flatnonzero(fits & ~alike & (s >= min(a for a, _ in limits)) & (s <= max(b for _, b in limits)))
            at = at[np.argsort(-s[at], kind="stable")]
            falling = -s[at]
            for place, (least, most) in enumerate(limits):
                begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                part = at[begin : min(begin + k, end)]
                out.append((anchors[k_anchor], place, s[part], ids[part]))
    counts = [len(o[2]) for o in out]
    cells = [np.repeat([o[0] for o in out], counts), np.repeat([o[1] for o in out], counts).astype(np.int32)]
    return pa.table([*cells, np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out])], schema=_FOUND)


_STATE = ["anchor_id", "label", "vec", "windows"]
_LISTED = "array<struct<place:int,score:bigint,vec_id:bigint>>"


def _rounds(anchors: DataFrame, index: MultiIndex, cells: DataFrame, binned: DataFrame, k: int, low: int | None, high: int | None, chunk: int, first_rows: int) -> DataFrame:
    """anchor_id and the best ``found`` (place, score, vec_id) of every anchor of ``anchors`` (_STATE), certified."""
    n = anchors.count()
    chunks = max(1, -(-n // chunk))
    state = written(anchors.select(*_STATE, F.lit(0).alias("passed"), F.array().cast(_LISTED).alias("found")), "anchors")
    done: list[DataFrame] = []
    rows = first_rows

    def planned(rows_now: int):
        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                queries, _ = _padded(batch.column("vec"), index.dim)
                visits = []
                for q, passed, windows in zip(queries, batch.column("passed").to_pylist(), batch.column("windows").to_pylist()):
                    limits = [_window(w["score"], low, high) for w in windows] if low is not None else []
                    least, most = (min(a for a, _ in limits), max(b for _, b in limits)) if limits else (None, None)
                    visits.append(index.visit(q, passed, rows_now, least, most))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("anchor_id"), pa.array([v[0] for v in visits], pa.list_(pa.int32())), pa.array([v[1] for v in visits], pa.int32()),
                     pa.array([v[2] for v in visits], pa.int64())],
                    ["anchor_id", "cells", "passed", "bound"],
                )

        return plan

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        return _search(own, asked, index.dim, k, low, high)

    while n:
        plan = written(state.select("anchor_id", "vec", "passed", "windows").mapInArrow(planned(rows), "anchor_id long, cells array<int>, passed int, bound long"), "plan")
        bins = F.explode(F.sequence(F.col("first_bin"), F.col("first_bin") + F.col("bins") - 1)).alias("bin")
        number = F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int").alias("chunk")
        wanted = plan.select("anchor_id", number, F.explode("cells").alias("cell")).join(cells, "cell").select("anchor_id", "chunk", bins)
        wanted = written(wanted, "wanted")
        asked = wanted.join(state.select(*_STATE), "anchor_id")
        needed = wanted.select(F.col("bin").alias("of_bin"), F.col("chunk").alias("for_chunk")).distinct()
        given = binned.join(needed, F.col("bin") == F.col("of_bin")).drop("bin")
        found = given.groupBy("of_bin", "for_chunk").cogroup(asked.groupBy("bin", "chunk")).applyInArrow(search, "anchor_id long, place int, score long, vec_id long")
        before = state.select("anchor_id", F.explode("found").alias("f")).select("anchor_id", "f.place", "f.score", "f.vec_id")
        best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
        merged = before.unionByName(found).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
        lists = merged.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "score", "vec_id")).alias("found"))
        moved = state.drop("passed", "found").join(plan.drop("cells"), "anchor_id").join(lists, "anchor_id", "left")
        moved = moved.withColumn("found", F.coalesce("found", F.array().cast(_LISTED)))
        state = written(moved.withColumn("certified", _certified(k, low)), "anchors")
        done.append(state.filter("certified").select("anchor_id", "windows", "found"))
        state = state.filter("not certified").select(*_STATE, "passed", "found")
        n, rows = state.count(), rows * GROWTH
    out = anchors.select("anchor_id", "windows").limit(0).withColumn("found", F.array().cast(_LISTED))
    for part in done:
        out = out.unionByName(part)
    return out


def _certified(k: int, low: int | None) -> Column:
    """Whether no unvisited row, of a score up to ``bound``, can enter any list of the anchor."""
    filled = lambda place: F.filter("found", lambda f: (f["place"] == place) & (f["score"] > F.col("bound")))
    if low is None:
        return F.col("bound").isNull() | (F.size(filled(F.lit(0))) >= k)
    numbered = F.transform("windows", lambda w, i: F.struct(i.alias("place"), w["score"].alias("score")))
    # all k of a list above the bound, or the whole window above it
    safe = lambda w: (F.size(filled(w["place"])) >= k) | (F.col("bound") * 100 < w["score"] * low)
    return F.col("bound").isNull() | F.forall(numbered, safe)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    codewords: int = CODEWORDS, sample: int = SAMPLE, bin_rows: int = BIN, chunk: int = CHUNK, first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``vectors`` as :func:`whole_components` makes them."""
    rows = written(vectors.select("vec_id", "label", "vec", is_anchor.alias("asks")), "vectors")
    index, cells, binned = build(rows, codewords, sample, bin_rows)
    asks = rows.filter("asks").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.max(F.struct("label", "vec")).alias("own"))
    none = F.array().cast("array<struct<score:bigint,vec_id:bigint>>").alias("windows")
    anchors = written(asks.select("anchor_id", "own.label", "own.vec", none), "anchors")
    near = written(_rounds(anchors, index, cells, binned, positives, None, None, chunk, first_rows), "positives")
    # a window of negative scores is empty
    opened = F.filter(F.transform("found", lambda f: F.struct(f["score"].alias("score"), f["vec_id"].alias("vec_id"))), lambda w: w["score"] >= 0)
    windows = near.select("anchor_id", F.array_sort(opened).alias("windows")).filter(F.size("windows") > 0)
    again = written(anchors.drop("windows").join(windows, "anchor_id").select(*_STATE), "windows")
    far = _rounds(again, index, cells, binned, negatives, low, high, chunk, first_rows)
    each = far.select("anchor_id", "windows", F.explode("found").alias("f")).select(
        "anchor_id", F.get("windows", F.col("f.place")).alias("w"), "f.place", F.col("f.vec_id").alias("negative_id"), F.col("f.score").alias("negative_score")
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return each.select(
        "anchor_id", F.col("w.vec_id").alias("positive_id"), F.row_number().over(order).alias("rank"), "negative_id",
        F.col("w.score").alias("positive_score"), "negative_score",
    )
