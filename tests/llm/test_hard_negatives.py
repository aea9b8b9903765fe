"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score double, found string, bin int"


def plain(rows, every, k=5, n=3):
    sound = [(i, y, [int(np.floor(256 * c)) for c in v]) for i, y, v in rows
             if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    anchors = {}
    for i, y, v in sound:
        if i % every == 0:
            anchors[i] = max(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, q) in anchors.items():
        scored = [(-sum(s * t for s, t in zip(q, v)), i, label) for i, label, v in sound if len(v) == len(q)]
        positives = sorted((s, i) for s, i, label in scored if label == y and i != a)[:k]
        for s, i in positives:
            ranked = sorted((t, j) for t, j, label in scored if label != y and 50 * -s <= 100 * -t <= 95 * -s)[:n]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(ranked)]
    return sorted(out)


def mined(spark, rows, every, **sizes):
    df = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(hard_negatives.whole_components(df), F.col("vec_id") % every == 0, **sizes).collect())


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, int(i % 4), [float(c) for c in centres[i % 6] + 0.4 * rng.normal(size=dim)]) for i in range(n)]


def test_equals_all_pairs_over_rounds_bins_and_chunks(spark):
    rows = clustered(900, 8, 1)
    assert mined(spark, rows, 20, codewords=6, sample=200, bin_rows=40, chunk=7, first_rows=60) == plain(rows, 20)


def test_ties_bad_rows_lengths_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in rng.integers(-1, 2, 4)]) for i in range(240)]
    rows += [(300 + i, i % 2, [1.0, 1.0, 0.0, 1.0]) for i in range(120)]  # a third of all rows is one vector
    rows += [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (501, 1, None), (502, 1, [1.0, None, 1.0, 1.0]), (503, 1, [float("nan")] * 4),
             (504, 1, [float("inf")] * 4), (510, 1, [1.0, 1.0]), (511, 2, [0.5, 1.0]), (512, 1, [1.0, 0.5]), (520, 1, []), (530, 2, [0.0] * 4)]
    assert mined(spark, rows, 10, codewords=4, bin_rows=16, chunk=5, first_rows=20) == plain(rows, 10)


def test_few_rows_and_none(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(10, 1, [1.0, 2.0])], 10) == []
    lone = [(10, 1, [1.0, 2.0]), (11, 2, [0.8, 0.9]), (12, 1, [1.0, 1.0])]
    assert mined(spark, lone, 10) == plain(lone, 10) != []


def test_visits_fall_and_bound_what_is_left():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(400, 6))).astype(np.int64)
    books = hard_negatives.codebook(x[:, :3], 5), hard_negatives.codebook(x[:, 3:], 5)
    index = hard_negatives.MultiIndex(6, books)
    halves = index.halves(x)
    at = [((h[:, None, :] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for h, b in zip(halves, books)]
    index.radii = tuple(np.array([np.sqrt(((h[a == k] - b[k]) ** 2).sum(axis=1)).max(initial=-np.inf) for k in range(len(b))]) for h, b, a in zip(halves, books, at))
    index.counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    np.add.at(index.counts, (at[0], at[1]), 1)
    cell = at[0] * len(books[1]) + at[1]
    for q in x[:20]:
        passed, seen, before = 0, set(), np.inf
        while True:
            cells, passed, bound = index.visit(q, passed, 50, None, None)
            seen |= set(cells)
            left = [s for s, c in zip(x @ q, cell) if c not in seen]
            if bound is None:
                assert not left
                break
            assert bound <= before and max(left) <= bound
            before = bound


def test_scores_too_large(spark):
    with pytest.raises(OverflowError):
        hard_negatives._scores(np.array([[2**40]]), np.array([[2**40]]))
