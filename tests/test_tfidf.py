import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticktide.operators import embedding as B
from ticktide.operators import tfidf as T
from ticktide.plans.queries_text import letter_mix

TEXTS = ["up up down", "Up down a", "", "flat", "down down up down"]


def counts(text):
    w = [t for t in text.lower().split(" ") if len(t) >= 2]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "news_id long, Processed string")


def test_counts(articles):
    got = Counter({(r.news_id, r.term): r.tf for r in T.ngram_counts(articles, "Processed", "news_id").collect()})
    assert got == Counter({(i, t): n for i, text in enumerate(TEXTS) for t, n in counts(text).items()})


def test_fit_and_transform(articles):
    per = [counts(t) for t in TEXTS]
    df = Counter(t for c in per for t in c)
    cf = sum(per, Counter())
    kept = sorted((t for t in df if 2 <= df[t] <= 0.85 * len(TEXTS)), key=lambda t: (-cf[t], t))[:3]
    idf = {t: math.log((1 + len(TEXTS)) / (1 + df[t])) + 1 for t in kept}
    vocabulary = T.tfidf_fit(articles, max_terms=3)
    assert {r.term: r.idf for r in vocabulary.collect()} == pytest.approx(idf)
    got = {(r.news_id, r.term): r.weight for r in T.tfidf_transform(articles, vocabulary).collect()}
    want = {}
    for i, c in enumerate(per):
        w = {t: (1 + math.log(c[t])) * idf[t] for t in kept if c[t]}
        size = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): x / size for t, x in w.items()})
    assert got == pytest.approx(want)


@pytest.mark.parametrize("most, words", [(3, 100_000), (40, 100_000), (400, 100_000), (40, 5)])
def test_fit_equals_counts_of_all_grams(spark, monkeypatch, most, words):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["up", "Up", "down", "x", "", "ขึ้น", "ß", "İn"] + [f"w{k * k % 60}" for k in range(60)], k=rng.randint(0, 40))) for _ in range(150)]
    texts += ["new york"] * 40 + ["often " * 30, None, "", "a"]
    articles = spark.createDataFrame([(t,) for t in texts], "Processed string")
    monkeypatch.setattr(T, "PART_BYTES", 500)
    monkeypatch.setattr(T, "MAX_WORDS", words)
    every = T.ngram_counts(articles).groupBy("term").agg(F.count("tf").alias("df"), F.sum("tf").alias("cf")).collect()
    per = sorted(((r.term, r.df, r.cf) for r in every if 2 <= r.df <= 0.85 * len(texts)), key=lambda r: (-r[2], r[0]))[:most]
    assert sorted(per) == sorted((r.term, r.df, r.cf) for r in T.tfidf_fit(articles, max_terms=most).collect())
    assert any(" " in t for t, _, _ in per) or most == 3


def test_pairs_with_a_rare_word_are_not_counted(spark):
    articles = spark.createDataFrame([("up down",)] * 3 + [("up one", ), ("two down",)], "Processed string")
    fits = (F.col("df") >= 2) & (F.col("df") <= 5)
    got = {(r.term, r.df, r.cf) for r in T._candidates(articles, "Processed", 2, fits).collect()}
    assert got == {("up", 4, 4), ("down", 4, 4), ("one", 1, 1), ("two", 1, 1), ("up down", 3, 3)}


@pytest.mark.parametrize("part", [1, 300, 4 << 20])
def test_transform_looks_up_words_over_arrays(spark, monkeypatch, part):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["up", "Up", "down", "x", "", "ขึ้น", "ß"] + [f"w{k}" for k in range(9)], k=rng.randint(0, 30))) for _ in range(80)] + [None, "", "a", "none of these"]
    articles = spark.createDataFrame([(i // 2 or None, ("A", None)[i % 2], t) for i, t in enumerate(texts)], "news_id long, Stock string, Processed string")
    idf = {"up": 1.5, "down": 2.0, "up down": 3.0, "ขึ้น ß": 1.0, "ขึ้น": 1.25, "w1 w2": 2.5, "w3 up": 1.75, "a b": 9.0, "x": 9.0, "up  up": 9.0, "up up up": 9.0, "": 9.0, "never": 9.0}
    vocabulary = spark.createDataFrame(list(idf.items()), "term string, idf double")
    monkeypatch.setattr(T, "PART_BYTES", part)
    found = T.tfidf_transform(articles, vocabulary, "Processed", "news_id", "Stock")
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    want = []
    for i, text in enumerate(texts):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in counts(text or "").items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        want += [(i // 2 or None, ("A", None)[i % 2], t, round(x / size, 12)) for t, x in w.items()]
    assert Counter((r.news_id, r.Stock, r.term, round(r.weight, 12)) for r in found.collect()) == Counter(want)
    assert T.tfidf_transform(articles, vocabulary.limit(0)).schema.simpleString() == T.tfidf_transform(articles, vocabulary).schema.simpleString()


def test_embedding_cache_embeds_only_new_texts(spark):
    rows = spark.createDataFrame([(1, "up"), (2, "up"), (3, "down"), (4, ""), (5, None)], "news_id long, Processed_Title string")
    known = spark.createDataFrame([("up", [9.0] * 8)], "text string, vec array<double>").withColumn("key", B.text_key(F.col("text")))
    out, new = B.embedding_cache(rows, known, letter_mix)
    assert sorted(r.text for r in new.collect()) == ["", "down"]
    got = {r.news_id: r.vec for r in out.collect()}
    assert len(got) == 5 and got[1] == got[2] == [9.0] * 8 and got[4] == got[5] and sum(got[3]) == pytest.approx(1)


def test_blank_texts_can_be_zero_vectors(spark):
    rows = spark.createDataFrame([("up",), (" ",)], "text string")
    got = {r.text: r.vec for r in B.embed_texts(rows, lambda: lambda xs: letter_mix()([x or "-" for x in xs]), blank=None).collect()}
    assert got[" "] == [0.0] * 8 and sum(got["up"]) == pytest.approx(1)
