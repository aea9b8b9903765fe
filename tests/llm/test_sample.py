"""The labelled sample is bounded in rows, not only in ids."""

from pyspark.sql import functions as F

from ticktide.llm import quality_classifier as Q


def test_one_row_for_each_id(spark):
    rows = [(1, f"copy {k % 7}" if k % 50 else None, k % 3) for k in range(600)] + [(i, f"text {i}", 1) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    got = Q.labelled_sample(docs.repartition(5), labels, F.lit(True)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 40))
    assert all((r["doc_id"], r["text"], r["stated"]) in {(i, t, float(n)) for i, t, n in rows} and r["quality"] == r["doc_id"] % 2 for r in got)
    again = Q.labelled_sample(docs.repartition(2, "text"), labels, F.lit(True)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(Q.labelled_sample(docs, labels, F.lit(True), 10).collect()) == 10
