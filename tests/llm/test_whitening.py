"""Whitening against a plain eigenvalue decomposition of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def plain(xs, weights=None):
    """deviation, whitened and explained shares of whole-number rows."""
    w = np.ones(len(xs)) if weights is None else np.array(weights, float)
    n = int(w.sum())
    sums = [sum(int(a) * int(b) for a, b in zip(w, xs[:, d])) for d in range(xs.shape[1])]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in xs]
    centred = np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in xs])
    values, vectors = np.linalg.eigh((centred.T * w) @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    return n, deviation, centred @ vectors / np.sqrt(np.maximum(values, 1e-300)), values


def check(rows, ids, xs, weights=None):
    n, deviation, white, values = plain(xs, weights)
    table = {}
    for r in rows:
        table.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(table) == sorted(ids)
    for k in range(white.shape[1]):
        own = np.array([table[i][k + 1]["whitened"] for i in ids])
        sign = np.sign((own * white[:, k]).sum())
        assert np.allclose(own, sign * white[:, k], atol=1e-7)
    for i, d in zip(ids, deviation):
        assert {(r["n"], int(r["deviation"])) for r in table[i].values()} == {(n, d)}
    assert all(r["identity_error"] < 1e-6 for r in rows)


def fixed(values):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in values])


def test_copies_bad_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1]
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 40, axis=0), vectors[1:9]])  # a third of all rows is one vector
    rows = [(i, [float(c) for c in v], 1, "own") for i, v in enumerate(vectors)]
    bad = [(900, None, 1, ""), (901, [1.0, None, 0.0, 0.0, 0.0], 1, ""), (902, [float("nan")] * 5, 1, ""), (903, [float("inf")] * 5, 1, "")]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(4)
    got = whitening.whiten(whitening.fixed_point(df)).collect()
    check(got, list(range(len(vectors))), fixed(vectors))
    shares = {r["component"]: r["explained"] for r in got}
    values = plain(fixed(vectors))[3]
    assert np.allclose([shares[k + 1] for k in range(5)], values / values.sum(), atol=1e-9)
    once, first = np.unique(fixed(vectors), axis=0, return_index=True)
    got = whitening.whiten(whitening.fixed_point(df.filter("vec_id < 900")), weights="one").collect()
    check([r for r in got if r["vec_id"] in set(first.tolist())], first.tolist(), once)


def test_lengths_are_fits_of_their_own(spark):
    rng = np.random.default_rng(4)
    short, long_ = rng.normal(size=(30, 3)) * 5, rng.normal(size=(50, 40)) * 5
    rows = [(i, [float(c) for c in v], 1, "") for i, v in enumerate(short)] + [(100 + i, [float(c) for c in v], 1, "") for i, v in enumerate(long_)]
    got = whitening.whiten(whitening.fixed_point(spark.createDataFrame(rows + [(500, [], 1, "")], SCHEMA))).collect()
    check([r for r in got if r["vec_id"] < 100], list(range(30)), fixed(short))
    rest = [r for r in got if r["vec_id"] >= 100]
    assert {r["component"] for r in rest} == set(range(1, 33)) and {r["vec_id"] for r in rest} == set(range(100, 150))


def test_where_nothing_varies(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (1, [1.0, 2.0], 1, ""), (None, [1.0, 2.0], 1, "")], SCHEMA)
    got = whitening.whiten(whitening.fixed_point(df)).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)
    flat = [(i, [float(i), 5.0], 1, "") for i in range(10)]
    got = whitening.whiten(whitening.fixed_point(spark.createDataFrame(flat, SCHEMA))).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and all(r["identity_error"] < 1e-9 for r in got)


def test_no_rows_and_numbers_beyond_64_bits(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(whitening.fixed_point(none)).collect() == []
    far = spark.createDataFrame([(i, [3e10 * i, 1.0 * (i % 3)], 1, "") for i in range(8)], SCHEMA)
    xs = fixed([[3e10 * i, 1.0 * (i % 3)] for i in range(8)])
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(whitening.fixed_point(far)).collect()}
    assert [got[i] for i in range(8)] == plain(xs)[1]
    with pytest.raises(ValueError):
        whitening.whiten(whitening.fixed_point(none), weights="two")
    many = spark.range(70).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0), (F.col("id") + 1).cast("int")).alias("embedding"))
    with pytest.raises(ValueError):
        whitening.whiten(whitening.fixed_point(many))
