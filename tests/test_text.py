import pytest
from pyspark.sql import functions as F

from ticktide.functions import text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("given, want", [
    ("A - B | C", "a"),
    ("A | B - C", "a"),
    ("X - Y - Z", "x y"),
    (None, ""),
    ("  \t ", ""),
    ("<b>Up</b> 5.2% https://a.b/c now", "up 52 now"),
    ("ขึ้น สูงสุด! กำไร", "ขึ้น สูงสุด กำไร"),
    ("a b　c", "a b c"),
    ("a - ", "a"),
])
def test_clean_title(spark, given, want):
    assert one(spark, given, X.clean_title) == want


def test_every_character_is_cleaned_as_by_the_plain_classes(spark):
    wanted = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(f"a{chr(c)}{chr(c)} {chr(c)}b {chr(c)}",) for c in wanted], "t string")
    bare = F.regexp_replace(F.lower("t"), X.NOT_WORD, "")
    plain = F.trim(F.regexp_replace(bare, f"[{X.SPACE}]+", " "))
    words = X.filter_tokens(plain, ["ab"])
    text = F.lower("t")
    odd = rows.filter((X.squeeze(F.regexp_replace(text, X._NOT_WORD, "")) != plain) | (X.clean_tokens(F.col("t"), ["ab"]) != words))
    assert odd.count() == 0


def test_clean_title_serving_falls_back(spark):
    for given in (None, "  ", "!!! - x", "<i></i>"):
        assert one(spark, given, X.clean_title_serving) == X.BLANK_HEADLINE
    assert one(spark, "the a - b", lambda c: X.clean_title_serving(c, ["the"])) == X.BLANK_HEADLINE


def test_clean_title_legacy(spark):
    assert one(spark, "www.x.y A\r\nB <i>c</i> http:z", X.clean_title_legacy) == "a b c"
    assert one(spark, "a <b\nc> d", X.clean_title_legacy) == "a b c d"
    assert one(spark, "a <b\nc> d", X.clean_title) == "a d"


def test_filter_tokens_keeps_finance_words(spark):
    stop = X.stop_list(["the", "ลง", "Buy", "of"], X.KEEP_DATASET)
    assert stop == ["of", "the"]
    assert one(spark, "the ลง x of up", lambda c: X.filter_tokens(c, stop)) == "ลง up"
    assert one(spark, "the of", lambda c: X.filter_tokens(c, stop)) == ""
    assert set(X.KEEP_LEGACY) < set(X.KEEP_SERVING) < set(X.KEEP_TFIDF) < set(X.KEEP_DATASET)


def test_split_headline(spark):
    head, source = X.split_headline(F.col("t"))
    rows = spark.createDataFrame([("A - B - C",), ("A",), ("A - ",)], "t string").select(head, source).collect()
    assert [tuple(r) for r in rows] == [("A - B", "C"), ("A", "Google News"), ("A", "")]


@pytest.mark.parametrize("given, want", [
    ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"),
    ("Tue, 2 Jan 2024 03:04:05 UTC", "2024-01-02 03:04:05"),
    ("yesterday", "yesterday"),
    ("Tue, 02 Foo 2024 03:04:05 GMT", "Tue, 02 Foo 2024 03:04:05 GMT"),
    (None, None),
])
def test_published(spark, given, want):
    assert one(spark, given, X.published_text) == want
