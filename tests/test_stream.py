from ticktide.streaming.news import append_unseen
from pyspark.errors import AnalysisException
import pytest
import datetime as dt

from pyspark.sql import functions as F

from ticktide.operators import serving as G
from ticktide.sources import files as IO
from ticktide.streaming import news as N

SCHEMA = "Stock string, symbol_rank int, ts timestamp_ntz, Link string"
T0 = dt.datetime(2024, 1, 1)


def items(spark, rows):
    return spark.createDataFrame([(s, r, T0 + dt.timedelta(hours=h), link) for s, r, h, link in rows], SCHEMA)


def test_links_are_stored_once_across_batches_symbols_and_restarts(spark, tmp_path):
    inbox, sink, state = (str(tmp_path / n) for n in ("inbox", "sink", "state"))

    def poll():
        N.news_stream(spark, inbox, SCHEMA, sink, state, every=None).awaitTermination()
        return sorted((r.Link, r.Stock) for r in spark.read.parquet(sink).collect())

    items(spark, [("B", 1, 0, "x"), ("A", 0, 1, "x"), ("A", 0, 2, "x"), ("B", 1, 0, "y")]).write.mode("append").parquet(inbox)
    assert poll() == [("x", "A"), ("y", "B")]
    items(spark, [("A", 0, 3, "y"), ("A", 0, 3, "z")]).write.mode("append").parquet(inbox)
    assert poll() == [("x", "A"), ("y", "B"), ("z", "A")]
    assert poll() == [("x", "A"), ("y", "B"), ("z", "A")]


def test_a_batch_run_again_adds_nothing(spark, tmp_path, monkeypatch):
    sink = str(tmp_path / "sink")
    batch = items(spark, [("A", 0, 0, "x"), ("B", 1, 0, "x"), ("B", 1, 0, "y")])
    for limit in (N.BROADCAST_ROWS, 0):
        monkeypatch.setattr(N, "BROADCAST_ROWS", limit)
        N.append_unseen(batch, sink, ("symbol_rank", "ts"))
        assert spark.read.parquet(sink).count() == 2
    N.append_unseen(batch.limit(0), sink, ("symbol_rank", "ts"))
    assert spark.read.parquet(sink).count() == 2


def test_lookback_leaves_old_items_out(spark, tmp_path):
    inbox, sink, state = (str(tmp_path / n) for n in ("inbox", "sink", "state"))
    items(spark, [("A", 0, 0, "old"), ("A", 0, 6, "edge"), ("A", 0, 30, "new")]).write.parquet(inbox)
    now = lambda batch: F.lit(T0 + dt.timedelta(hours=30)).cast("timestamp_ntz")
    N.news_stream(spark, inbox, SCHEMA, sink, state, now=now, every=None).awaitTermination()
    assert sorted(r.Link for r in spark.read.parquet(sink).collect()) == ["edge", "new"]


def test_missing_files_give_empty_frames(spark, tmp_path):
    assert IO.read_snapshot(spark, str(tmp_path / "none")).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text("not json")
    assert IO.read_snapshot(spark, str(bad)).count() == 0
    good = tmp_path / "rf.json"
    good.write_text('[{"stock": "A", "auc_roc": 0.6},\n {"stock": "B", "auc_roc": 0.5}]')
    got = IO.read_reports(spark, {"rf": str(good), "svm": str(bad), "lstm": str(tmp_path / "none")}, one_array=True)
    assert sorted((r.model, r.Stock, r.auc_roc) for r in got.collect()) == [("rf", "A", 0.6), ("rf", "B", 0.5)]


def test_quotes(spark):
    symbols = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "Stock string")
    rows = [("A", 1, 10.0), ("A", 2, 9.5), ("B", 1, 0.0), ("B", 2, 1.0), ("C", 1, 3.0)]
    prices = spark.createDataFrame(rows, "Stock string, Date int, Close double")
    got = {r.Stock: (r.price, r.change, r.is_positive) for r in G.latest_quote(symbols, prices).collect()}
    assert got == {"A": ("9.50", "-0.50 (-5.00%)", False), "B": ("1.00", "+1.00 (+0.00%)", True), "C": ("-", "-", True), "D": ("-", "-", True)}


def test_sparkline_edges(spark):
    h = spark.createDataFrame([("A", 1, 5.0, 2), ("A", 2, 5.0, 1), ("B", 1, 7.0, 1)], "Stock string, Date int, close double, back int")
    assert sorted((r.Stock, r.x, r.y) for r in G.sparkline_points(h).collect()) == [("A", 0.0, 0.0), ("A", 1.0, 0.0), ("B", 0.0, 0.5)]


def test_feed_puts_missing_times_last(spark):
    symbols = spark.createDataFrame([("A", 0), ("B", 1)], "Stock string, symbol_rank int")
    s = "Stock string, headline string, timestamp double, item_rank int"
    stored = spark.createDataFrame([("B", "b1", None, 1), ("B", "b2", 5.0, 2)], s)
    fresh = spark.createDataFrame([("A", "a1", 7.0, 1), ("A", "a2", None, 2), ("B", "x", 9.0, 1), ("A", "a4", 8.0, 4)], s)
    got = G.merged_feed(symbols, stored, fresh)
    assert [r.headline for r in got.collect()] == ["a1", "b2", "a2", "b1"]
    assert [r.headline for r in G.filter_feed(got, "A").collect()] == ["a1", "a2"]
    assert G.filter_feed(got).count() == 4


def test_sink_that_cannot_be_read_is_not_taken_for_an_empty_one(spark, tmp_path):
    sink = str(tmp_path / "sink")
    spark.createDataFrame([("a",)], "Other string").write.parquet(sink)
    batch = spark.createDataFrame([("l1", 1)], "Link string, ts int")
    with pytest.raises(AnalysisException):
        append_unseen(batch, sink, ["ts"])
    assert spark.read.parquet(sink).count() == 1


def test_state_remembers_links_across_batches_symbols_and_restarts(spark, tmp_path):
    inbox, sink, state = (str(tmp_path / n) for n in ("inbox", "sink", "state"))
    stored = spark.createDataFrame([("old",)], "Link string")
    before = spark.conf.get(N.STATE_STORE, None)

    def poll():
        N.news_stream_with_state(spark, inbox, SCHEMA, sink, state, stored=stored, every=None).awaitTermination()
        return sorted((r.Link, r.Stock) for r in spark.read.parquet(sink).collect())

    items(spark, [("B", 1, 0, "x"), ("A", 0, 2, "x"), ("A", 0, 1, "x"), ("B", 1, 0, "y"), ("A", 0, 0, "old")]).write.mode("append").parquet(inbox)
    assert poll() == [("x", "A"), ("y", "B")]
    items(spark, [("A", 0, 3, "y"), ("A", 0, 3, "z"), ("A", 0, 0, "x")]).write.mode("append").parquet(inbox)
    assert poll() == [("x", "A"), ("y", "B"), ("z", "A")]
    assert poll() == [("x", "A"), ("y", "B"), ("z", "A")]
    assert spark.conf.get(N.STATE_STORE, None) == before


def test_a_broken_snapshot_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    row = lambda day: spark.createDataFrame([("A", day)], "Stock string, date string")
    IO.write_snapshot(row("1999-01-01"), path)
    held = IO.read_snapshot(spark, path)
    bad = row("1999-01-02").withColumn("date", F.raise_error(F.lit("broken off")).cast("string"))
    with pytest.raises(Exception, match="broken off"):
        IO.write_snapshot(bad, path)
    assert [r.date for r in IO.read_snapshot(spark, path).collect()] == ["1999-01-01"]
    IO.write_snapshot(row("1999-01-03"), path)
    assert [r.date for r in IO.read_snapshot(spark, path).collect()] == ["1999-01-03"]
    assert [r.date for r in held.collect()] == ["1999-01-01"]
