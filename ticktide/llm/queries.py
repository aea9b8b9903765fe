"""The operators as queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import (
    hard_negatives, jaccard, license_scan, mixing, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_files, topk, warc,
    whitening,
)
from ticktide.session import scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = license_scan.license_spans(_table(spark, folder, "documents"))
    base = F.array_distinct("places.label")
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_distinct(F.concat(base, F.col("spans.label")))).alias("labels"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"),
    )


def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.whole_components(_table(spark, folder, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard(_table(spark, folder, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_copies, n_links (other sets of word runs at 0.8 or more)."""
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken", ",").alias("broken"),
    )


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.round_trip(spark, _table(spark, folder, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), VOCABULARY)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    machine = quality_classifier.fit(docs, labels, ~held_out(F.col("doc_id")))
    scored = quality_classifier.score(docs, machine)
    likely = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", likely.alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return cut.select(
        "doc_id",
        n_bytes.cast("long").alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("changed"),
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(whitening.fixed_point(_table(spark, folder, "embeddings")))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "token_files")
    token_files.write_tokens(_table(spark, folder, "documents"), path, WORD_VOCABULARY, keep=("lang", "source"))
    return token_files.checksums(token_files.read_tokens(spark, path))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.whole_components(vectors.withColumn("label", moved))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_exact_topk, op3_sharding, op4_ngram_jaccard, op5_quality_rules, op6_warc, op7_mixing,
        op8_packing, op9_quality_classifier, op10_suffix_dedup, op11_whitening, op12_token_output, op13_hard_negatives,
    )
}

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vec) = len(q.vec)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10
"""


def _rules_sql() -> str:
    """The same counts and thresholds, windows compared as text."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    checks = []
    for rule in (*quality_rules.BASE, *quality_rules.RULES):
        over, under = rule.over, "1" if rule.under == "one" else rule.under
        tests = [f"{over} * 100 < {under} * {rule.least}"] * (rule.least is not None)
        tests += [f"{over} * 100 > {under} * {rule.most}"] * (rule.most is not None)
        checks.append(f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), g AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), repeats AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, range(0, 5) t(k)) GROUP BY r
), counted AS (
  SELECT s.doc_id, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same_as_before,
    len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(regexp_extract_all(text, '!')) AS n_exclamation
  FROM s LEFT JOIN repeats ON repeats.r = s.r
), judged AS (
  SELECT *, array_to_string(list_filter([{", ".join(checks)}], lambda x: x IS NOT NULL), ',') AS broken FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, broken = '' AS kept, broken
FROM judged
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON len(c.vec) = len(a.vec) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id, score FROM pairs WHERE alike AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS n
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE n <= 3
"""

# five hexadecimal digits of the digest make four letters
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(sha1, {5 * k + 1}, 5) AS BIGINT) // {32 ** (3 - j)}) % 32 + 1, 1)"
    for k in range(8)
    for j in range(4)
)
WARC_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha1 FROM pages
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha1) AS response_id FROM p
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN response_id IS NOT NULL AND (page_id IS NULL OR page_id < response_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response_id IS NOT NULL AND (page_id IS NULL OR page_id < response_id) THEN response_id END AS refers_to
FROM f
"""

ORACLES = {"op2_exact_topk": TOPK_SQL, "op5_quality_rules": _rules_sql(), "op6_warc": WARC_SQL, "op13_hard_negatives": NEGATIVES_SQL}
