import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from ticktide.functions import display, vectors as V
from ticktide.operators import metrics as M
from ticktide.operators import models as L
from ticktide.operators import panel as P
from ticktide.operators import scaling as S
from ticktide.plans.dataset import modelling_panel

DAY = dt.date(2024, 1, 1)


def days(n, stock="A"):
    return [(stock, DAY + dt.timedelta(i)) for i in range(n)]


def test_label_treats_nan_as_missing(spark):
    nan = float("nan")
    rows = [("A", 1, 10.0, 10.0), ("A", 2, 11.0, nan), ("A", 3, 9.0, 8.0), ("A", 4, nan, 7.0), ("A", 5, 8.0, 7.0), ("B", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "Stock string, Date int, Open double, Close double").withColumns({"High": F.lit(0.0), "Low": F.lit(0.0), "Volume": F.lit(1.0)})
    got = {r.Date: (r.Prev_Close, r.Target_Label) for r in P.label_open_direction(df).collect()}
    assert got == {2: (10.0, 1), 4: (8.0, 0), 5: (7.0, 1)}


def test_dedup_keeps_first(spark):
    rows = [(5, "A", "x"), (3, "A", "x"), (4, "B", "x"), (1, "A", None), (2, "A", None)]
    got = P.dedup_news(spark.createDataFrame(rows, "news_id long, Stock string, Title string")).collect()
    assert sorted(r.news_id for r in got) == [1, 3, 4]


@pytest.mark.parametrize("n", [0, 1, 10, 59, 60, 79, 80, 90])
def test_split_sizes(spark, n):
    df = spark.createDataFrame(days(n), "Stock string, Target_Date date")
    got = {r.split: r.n for r in P.chrono_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    train, val = int(n * 0.70), int(n * 0.15)
    assert got == {k: v for k, v in (("train", train), ("val", val), ("test", n - train - val)) if v}


def test_sequences(spark):
    rows = [(s, d, i % 2, [float(i)]) for i, (s, d) in enumerate(days(40))]
    df = spark.createDataFrame(rows, "Stock string, Target_Date date, Target_Label int, features array<double>")
    got = P.sliding_sequences(df, window=2).orderBy("seq_no").collect()
    assert len(got) == 38 and got[0].sequence == [[0.0], [1.0]] and got[0].Target_Label == 0
    assert [sum(r.split == p for r in got) for p in ("train", "val", "test")] == [27, 6, 5]
    assert P.sliding_sequences(df.limit(9)).count() == 0


def test_wide_to_long_drops_empty_bars(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0, None, None), (2, 3.0, None, None, None)], "Date int, `Open|A.BK` double, `Close|A.BK` double, `Open|B.BK` double, `Close|B.BK` double")
    got = P.plain_symbols(P.wide_to_long(wide)).collect()
    assert [(r.Date, r.Stock, r.Open, r.Close, r.High) for r in got] == [(1, "A", 1.0, 2.0, None), (2, "A", 3.0, None, None)]
    kept = spark.createDataFrame([("A.BK",)], "Stock string")
    assert P.plain_symbols(kept).first().Stock == "A.BK"


def test_hot_key_joins_lose_nothing(spark):
    large = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    small = large.select("k").distinct().withColumn("v", F.length("k"))
    want = sorted(large.join(small, "k").select("id", "k", "v").collect())
    assert sorted(P.join_spread(large, small, ["k"], F.col("id"), 8).select("id", "k", "v").collect()) == want
    assert sorted(P.join_hot_keys(large, small, "k", F.col("id"), 8, 0.1).select("id", "k", "v").collect()) == want


def test_scale_uses_train_rows_and_leaves_constants(spark):
    rows = [("A", "train", [1.0, 5.0]), ("A", "train", [3.0, 5.0]), ("A", "test", [100.0, 7.0])]
    df = spark.createDataFrame(rows, "Stock string, split string, v array<double>")
    got = S.standard_scale(df, "v", train=F.col("split") == "train").collect()
    assert sorted(r.v for r in got) == [[-1.0, 0.0], [1.0, 0.0], [98.0, 2.0]]


def test_vector_helpers(spark):
    inf = float("inf")
    df = spark.createDataFrame([([1.0, float("nan"), inf, -inf, None],)], "v array<double>")
    assert df.select(V.nan_to_num(F.col("v"))).first()[0] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert V.numbered(["vec_10", "vec_2", "x", "vec_a"], "vec_") == ["vec_2", "vec_10"]
    with pytest.raises(ValueError):
        V.columns_to_vector(df)


def test_rounding_is_that_of_python(spark):
    random.seed(1)
    xs = [random.choice([1, -1]) * random.randint(0, 99999) / 1000 for _ in range(300)] + [0.125, 2.5, 1234567.005]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", display.fixed(F.col("x"), 2).alias("s"), display.half_even(F.col("x"), 2).alias("h"))
    for r in df.collect():
        assert r.s == f"{r.x:.2f}" and r.h == round(r.x, 2)


def test_time_folds(spark):
    df = spark.createDataFrame(days(20), "Stock string, Target_Date date")
    got = M.time_series_folds(df).collect()
    for fold in range(5):
        part = sorted((r.Target_Date, r.role) for r in got if r.fold == fold)
        assert [x for _, x in part] == ["train"] * (20 - (5 - fold) * 3) + ["test"] * 3


def test_class_balance(spark):
    df = spark.createDataFrame([("A", 0), ("A", 0), ("A", 1), ("B", 1), ("C", 0)], "Stock string, Target_Label int")
    got = {r.Stock: (r.weight_0, r.weight_1) for r in M.class_weights(df).collect()}
    assert set(got) == {"A"} and math.isclose(got["A"][0], 0.75) and math.isclose(got["A"][1], 1.5)
    assert {r.Stock: r.scale_pos_weight for r in M.scale_pos_weight(df).collect()} == {"A": 2.0, "B": 0.0, "C": 1.0}


def test_train_cutoff(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(10)] * 2, "Target_Date date")
    assert P.train_cutoff(df).first().cutoff == DAY + dt.timedelta(7)
    assert P.global_train_split(df).filter("is_train").count() == 16


def test_gates(spark):
    rows = days(3, "A") + days(2, "B")
    df = spark.createDataFrame(rows, "Stock string, Target_Date date")
    assert {r.Stock: r.enough for r in P.rows_per_stock(df, 3).collect()} == {"A": True, "B": False}
    assert {r.Stock for r in P.enough_rows(df, 3).collect()} == {"A"}


def test_lagged_prices(spark):
    rows = [(s, d, float(i)) for i, (s, d) in enumerate(days(3))]
    df = spark.createDataFrame(rows, "Stock string, Target_Date date, Open double")
    df = df.withColumns({c: F.col("Open") + 10 for c in P.PRICE_COLUMNS if c != "Open"})
    got = L.lagged_prices(df).orderBy("Target_Date").collect()
    assert [(r.Target_Date, r.Open, r.Close) for r in got] == [(DAY + dt.timedelta(1), 0.0, 10.0), (DAY + dt.timedelta(2), 1.0, 11.0)]


def test_kept_news_need_no_title(spark):
    news = spark.createDataFrame(
        [(1, "A", "2024-01-01", "up"), (2, "A", "2024-01-01", "up"), (3, "A", "2024-01-01", "down"), (3, "A", "2024-01-01", "down"), (4, None, "2024-01-01", None)],
        "news_id long, Stock string, Date string, Title string",
    )
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 5)], "news_id long, vec array<double>")
    prices = spark.createDataFrame([("A", f"2024-01-0{k}", 1.0, 2.0, 1.0, 2.0, 9.0) for k in (1, 2, 3)], "Stock string, Date string, Open double, High double, Low double, Close double, Volume double")
    prices = prices.withColumn("Date", F.to_date("Date"))
    kept = P.shift_target_date(P.dedup_news(news)).select("news_id", "Stock", F.col("Target_Date").alias("Date"))
    got = modelling_panel(kept, vec, prices, shift_days=0, unique=True).collect()
    assert got == modelling_panel(news, vec, prices).collect() and [(r.n_news, r.vec) for r in got] == [(3, [7 / 3, 1.0])]
