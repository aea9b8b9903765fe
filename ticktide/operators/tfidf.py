"""TF-IDF over word uni- and bigrams, kept sparse: one row per article and term.

Terms are split at white space. Counting happens inside the row (sorted grams, run
lengths), so the grams of an article never travel; what is shuffled are term totals,
summed per task first. Weights and their length are worked out inside the row too.
The fit counts words first, over arrays, and then only those pairs that can be terms;
the transform looks up words and pairs of the vocabulary over arrays as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ticktide.operators import panel as P
from ticktide.session import written

MAX_TERMS, MIN_DF, MAX_DF = 400, 2, 0.85
#: Most words whose pairs are counted by number; with more of them the grams of all words are counted as text.
MAX_WORDS = 100_000
#: Bytes of text that a task turns into arrays at once; a longer text is taken whole.
PART_BYTES = 4 << 20


def word_tokens(text: Column) -> Column:
    """Lower-cased words of at least two characters."""
    return F.filter(F.split(F.lower(text), " "), lambda t: F.length(t) >= 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row; plain reuse would compute it per mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(words: Column) -> Column:
    """Words followed by neighbouring pairs."""

    def both(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(words, both)


def run_lengths(values: Column) -> Column:
    """Distinct values and their counts as an array of (term, tf)."""

    def runs(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))

        def ended(s: Column) -> Column:
            ends = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(v)))
            entry = lambda a, b: F.struct(F.get(v, a).alias("term"), (b - a).alias("tf"))
            return F.zip_with(s, ends, entry)

        return F.when(F.size(v) > 0, let(starts, ended))

    return let(F.sort_array(values), runs)


def ngram_counts(articles: DataFrame, text: str = "Processed", *keep: str) -> DataFrame:
    """(``keep``..., term, tf) for every distinct gram of every article."""
    entries = run_lengths(grams(word_tokens(F.col(text))))
    return articles.select(*keep, F.inline_outer(entries)).filter(F.col("term").isNotNull())


_TOTALS = "term string, df long, cf long"
_ENTRIES = ArrayType(StructType([StructField("term", StringType()), StructField("weight", DoubleType())]))


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row and word of all words of at least two characters, of some PART_BYTES of text at once; later rows come in later parts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
        lists = pc.split_pattern(texts.slice(first, last - first), " ")
        row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
        long_ = pc.greater_equal(pc.utf8_length(word), 2)
        yield row.filter(long_).to_numpy().astype(np.int64) + first, word.filter(long_)
        first = last


def _totals(row: np.ndarray, gram: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of ``gram``, all less than ``below``, in how many rows each is, and how often."""
    both, tf = np.unique(row.astype(np.int64) * below + gram, return_counts=True)
    found, of = np.unique(both % below, return_inverse=True)
    return found, np.bincount(of, minlength=len(found)), np.bincount(of, tf, len(found)).astype(np.int64)


def _table(term: pa.Array, df: np.ndarray, cf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "df", "cf"])


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, word in _words(batch.column(0)):
            if len(word):
                coded = word.dictionary_encode()
                found, df, cf = _totals(row, coded.indices.to_numpy(), len(coded.dictionary))
                yield _table(coded.dictionary.take(pa.array(found)), df, cf)


def _pair_totals(known: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Totals of neighbouring words that are both ``known``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array(known, batch.column(0).type)
            for row, word in _words(batch.column(0)):
                number = pc.fill_null(pc.index_in(word, value_set=names), -1).to_numpy().astype(np.int64)
                at = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
                if len(at):
                    found, df, cf = _totals(row[at], number[at] * len(known) + number[at + 1], len(known) ** 2)
                    a, b = (names.take(pa.array(x)) for x in np.divmod(found, len(known)))
                    yield _table(pc.binary_join_element_wise(a, b, " "), df, cf)

    return count


def _candidates(train: DataFrame, text: str, max_terms: int, fits: Column) -> DataFrame:
    """(term, df, cf) of all grams that can be among the ``max_terms`` most frequent ones that ``fits``, and of others.

    A pair comes at most as often as either of its words, and ``max_terms`` words that fit are as good as terms. So a pair
    of which one word comes less often than the last of these words can't be a term, and isn't counted.
    """
    lowered = train.select(F.lower(text).alias("text"))
    total = lambda df: df.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    words = written(total(lowered.mapInArrow(_word_totals, _TOTALS)), "words")
    best = [x.cf for x in words.filter(fits).orderBy(F.desc("cf")).limit(max_terms).select("cf").collect()]
    least = best[-1] if 0 < max_terms == len(best) else 1
    known = [x.term for x in words.filter(F.col("cf") >= least).select("term").limit(MAX_WORDS + 1).collect()]
    if len(known) > MAX_WORDS:
        return ngram_counts(train, text).groupBy("term").agg(F.count("tf").alias("df"), F.sum("tf").alias("cf"))
    return words.unionByName(total(lowered.mapInArrow(_pair_totals(known), _TOTALS)))


def tfidf_fit(
    train: DataFrame, text: str = "Processed", max_terms: int = MAX_TERMS, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """Vocabulary (term, df, cf, idf) of the train articles; at most ``max_terms`` rows."""
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    fits = (F.col("df") >= min_df) & (F.col("df") <= n * F.lit(float(max_df)))
    return (
        _candidates(train, text, max_terms, fits).filter(fits)
        .orderBy(F.desc("cf"), F.asc("term"))
        .limit(max_terms)
        .withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)
    )


def _weights_of(terms: list[str], idf: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last column, lower-cased texts, as lists of (term, weight) in order of ``terms``, which are sorted."""
    parts = [t.split(" ") for t in terms]
    known = sorted({w for p in parts for w in p})
    place = {w: i for i, w in enumerate(known)}
    # numbers of words and of pairs of words that are terms; the words of a text hold no blanks, so there are no other terms
    codes = np.array([place[p[0]] if len(p) == 1 else len(known) * (place[p[0]] + 1) + place[p[1]] if len(p) == 2 else -1 for p in parts])
    order = np.argsort(codes, kind="stable")

    def hits(row: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = np.searchsorted(codes, code, sorter=order).clip(0, len(order) - 1)
        found = (codes[order[at]] == code) & (code >= 0)
        return row[found] * len(terms) + order[at[found]]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            names, all_terms = pa.array(known, texts.type), pa.array(terms, pa.string())
            found = [np.zeros(0, np.int64)]
            for row, word in _words(texts):
                number = pc.fill_null(pc.index_in(word, value_set=names), -1).to_numpy().astype(np.int64)
                at = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
                found += [hits(row, number), hits(row[at], len(known) * (number[at] + 1) + number[at + 1])]
            both, tf = np.unique(np.concatenate(found), return_counts=True)
            row, term = np.divmod(both, len(terms))
            raw = (np.log(tf) + 1.0) * idf[term]
            weight = raw / np.sqrt(np.bincount(row, raw * raw, batch.num_rows))[row]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            entries = pa.StructArray.from_arrays([all_terms.take(pa.array(term)), pa.array(weight)], ["term", "weight"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*others, lists], [*batch.schema.names[:-1], "entries"])

    return weigh


def tfidf_transform(articles: DataFrame, vocabulary: DataFrame, text: str = "Processed", key: str = "news_id", *keep: str) -> DataFrame:
    """(key, ``keep``..., term, weight): sublinear tf times idf, unit length per article; nothing is shuffled.

    The vocabulary is bounded by ``max_terms``, so its rows travel to every task. Other grams drop out before they are counted.
    """
    known = sorted((x.term, x.idf) for x in vocabulary.select("term", "idf").collect())
    given = articles.select(key, *keep)
    if not known:
        return given.filter(F.lit(False)).select("*", F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    weigh = _weights_of([t for t, _ in known], np.array([i for _, i in known], float))
    schema = StructType([*given.schema.fields, StructField("entries", _ENTRIES)])
    found = articles.select(key, *keep, F.lower(text).alias("entries")).mapInArrow(weigh, schema)
    return found.select(key, *keep, F.inline("entries"))


def top_idf_terms(vocabulary: DataFrame, n: int = 20) -> DataFrame:
    return vocabulary.orderBy(F.desc("idf"), F.asc("term")).limit(n).select("term", "df", "idf")


def _daily_sums(weights: DataFrame) -> DataFrame:
    return weights.groupBy("Stock", "Target_Date", "term").agg(F.sum("weight").alias("weight"))


def _daily_articles(articles: DataFrame) -> DataFrame:
    return articles.groupBy("Stock", "Target_Date").agg(F.count(F.lit(1)).alias("n_news"))


def top_terms_by_label(articles: DataFrame, weights: DataFrame, labelled: DataFrame, n: int = 10) -> DataFrame:
    """Per label the ``n`` terms of highest mean weight over all its articles.

    Weights are summed per symbol and day before they meet the labels, so no join key is hot.
    """
    labels = labelled.select("Stock", F.col("Date").alias("Target_Date"), "Target_Label")
    sums = (
        _daily_sums(weights).join(labels, ["Stock", "Target_Date"])
        .groupBy("Target_Label", "term").agg(F.sum("weight").alias("weight"))
    )
    sizes = (
        _daily_articles(articles).join(labels, ["Stock", "Target_Date"])
        .groupBy("Target_Label").agg(F.sum("n_news").alias("n_articles"))
    )
    means = sums.join(sizes, "Target_Label").withColumn("mean_weight", F.col("weight") / F.col("n_articles"))
    w = Window.partitionBy("Target_Label").orderBy(F.desc(F.round("mean_weight", 12)), F.asc("term"))
    return (
        means.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
        .select("Target_Label", "place", "term", "mean_weight", "n_articles")
    )


def daily_tfidf(articles: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean TF-IDF vector per symbol and day as a map from term to weight, zeros left out."""
    entries = (
        _daily_sums(weights).groupBy("Stock", "Target_Date")
        .agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_e"))
    )
    joined = _daily_articles(articles).join(entries, ["Stock", "Target_Date"], "left")
    empty = F.array().cast("array<struct<term:string,weight:double>>")
    mean = F.transform(
        F.coalesce("_e", empty),
        lambda e: F.struct(e["term"].alias("term"), (e["weight"] / F.col("n_news")).alias("weight")),
    )
    return joined.select("Stock", "Target_Date", "n_news", F.map_from_entries(mean).alias("tfidf"))


def tfidf_daily_dataset(articles: DataFrame, labelled: DataFrame, text: str = "Processed", max_terms: int = MAX_TERMS) -> DataFrame:
    """Train-fitted TF-IDF, pooled per day and joined to the labelled prices."""
    return tfidf_panel(articles, labelled, tfidf_fit(P.global_train_split(articles).filter("is_train"), text, max_terms), text)


def tfidf_panel(articles: DataFrame, labelled: DataFrame, vocabulary: DataFrame, text: str = "Processed") -> DataFrame:
    """The daily dataset for a given vocabulary."""
    weights = tfidf_transform(articles, vocabulary, text, "news_id", "Stock", "Target_Date")
    return P.join_news_prices(daily_tfidf(articles, weights), labelled).select(
        "Stock", "Target_Date", *P.PRICE_COLUMNS, "Target_Label", "n_news", "tfidf"
    )


def dense_terms(dataset: DataFrame, vocabulary: DataFrame, tfidf: str = "tfidf", vec: str = "vec") -> DataFrame:
    """``dataset`` with its term map as a vector in the order of terms; the vocabulary is bounded by ``max_terms``."""
    terms = F.lit(sorted(x.term for x in vocabulary.select("term").collect())).cast("array<string>")
    weight = lambda t: F.coalesce(F.element_at(F.col(tfidf), t), F.lit(0.0))
    return dataset.withColumn(vec, F.transform(terms, weight)).drop(tfidf)
