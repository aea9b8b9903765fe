import random

import pytest
from pyspark.sql import functions as F

from ticktide.functions import text as X
from ticktide.functions.segment import _UNIT, segment
from ticktide.operators import tfidf as T


def every_split(units, words):
    """All ways through ``units`` by words of the list and single units outside it, as (unit count, is word)."""
    if not units:
        yield []
        return
    for n in range(1, len(units) + 1):
        if "".join(units[:n]) in words:
            yield from ([(n, True), *rest] for rest in every_split(units[n:], words))
    yield from ([(1, False), *rest] for rest in every_split(units[1:], words))


def plain(text, words):
    units = _UNIT.findall(text)
    best = min(every_split(units, words), key=lambda s: (sum(not w for _, w in s), len(s), [(-n, not w) for n, w in s]))
    out, at, open_ = [], 0, False
    for n, word in best:
        piece = "".join(units[at : at + n])
        if not word and open_:
            out[-1] += piece
        else:
            out.append(piece)
        at, open_ = at + n, not word
    return " ".join(out)


@pytest.mark.parametrize("letters", ["abc", "กาเ่ข", "กขค"])
def test_as_a_search_over_all_splits(spark, letters):
    draw = random.Random(5)
    word = lambda most: "".join(draw.choice(letters) for _ in range(draw.randint(1, most)))
    words = sorted({word(4) for _ in range(12)})
    texts = sorted({word(10) for _ in range(400)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = dict(df.select("t", segment(F.col("t"), words, "[a-zก-๎]")).collect())
    assert got == {t: plain(t, set(words)) for t in texts}


LIST = ["หุ้น", "ไทย", "ขึ้น", "แรง", "วันนี้", "ที่", "ตลาด"]


@pytest.mark.parametrize("given, want", [
    ("หุ้นไทยขึ้นแรงวันนี้", "หุ้น ไทย ขึ้น แรง วันนี้"),
    ("ตลาดหุ้นabc 52ขึ้น", "ตลาด หุ้น abc 52 ขึ้น"),
    ("หุ้นกขคไทย", "หุ้น กขค ไทย"),
    ("กขค", "กขค"),
    ("up 5", "up 5"),
    ("  a  b", "  a  b"),
    ("", ""),
    (None, None),
])
def test_words(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(segment(F.col("t"), LIST)).first()[0] == want


def test_no_list_and_repeated_words(spark):
    df = spark.createDataFrame([("หุ้นไทย",)], "t string")
    assert df.select(segment(F.col("t"), [])).first()[0] == "หุ้นไทย"
    assert df.select(segment(F.col("t"), ["ไทย", "ไทย", "", None])).first()[0] == "หุ้น ไทย"
    assert df.filter("false").select(segment(F.col("t"), LIST)).count() == 0


def test_long_text(spark):
    df = spark.range(1).select(F.repeat(F.lit("หุ้นไทย"), 100_000).alias("t"))
    words = df.select(F.split(segment(F.col("t"), LIST), " ").alias("w")).first().w
    assert words == ["หุ้น", "ไทย"] * 100_000


def test_filters_and_grams_follow(spark):
    df = spark.createDataFrame([("<b>หุ้นไทยที่ขึ้น!</b> - ข่าว",)], "t string")
    kept = X.filter_tokens(segment(X.clean_title(F.col("t")), LIST), ["ที่"])
    assert df.select(kept).first()[0] == "หุ้น ไทย ขึ้น"
    grams = T.ngram_counts(df.select(kept.alias("Processed"))).collect()
    assert {g.term for g in grams} == {"หุ้น", "ไทย", "ขึ้น", "หุ้น ไทย", "ไทย ขึ้น"}
