"""A corpus for training from raw documents: each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import jaccard, mixing, packing, quality_classifier, suffix_dedup
from ticktide.llm.queries import VOCABULARY
from ticktide.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above, learned from all labels of the folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_classifier.fit(docs, labels, F.lit(True))
    return quality_classifier.keep(docs, machine).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id; all documents without an id stay."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that also stand elsewhere; a character cut in two goes as well."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those taken no times go."""
    return mixing.repeat(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeats),
    ("mixing", mixture),
    ("packing", pack),
]

# models, tokens and suffixes are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir.rstrip("/")), name)
    return STAGES[-1][1](spark, docs, sf_dir.rstrip("/"))
