"""Every stage of the pipeline against a plain version, each on what the one before kept."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import plain
from ticktide.llm import quality_classifier
from ticktide.session import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage was given and what it returned, as rows."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, FOLDER), name)
        out.append((docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_stages_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "suffix_dedup", "mixing", "packing"]
    assert all(columns == corpus_pipeline.COLUMNS for _, _, columns in kept[:-1])


def test_quality_keeps_what_the_classifier_scores_high(spark, kept):
    given, got, _ = kept[0]
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality_classifier.fit(docs, labels, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, machine).collect()}
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in given if scores[r["doc_id"]] >= quality_classifier.THRESHOLD}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = {r["doc_id"] for r in got}
    good, bad = ([i in ids for i, q in marked.items() if q == k] for k in (1, 0))
    assert np.mean(good) > 0.9 and np.mean(bad) < np.mean(good)  # a few dozen labels only; accuracy is tested on sf0.01


def test_one_of_each_class_of_near_copies_stays(kept):
    given, got, _ = kept[1]
    classes = plain.near_classes({r["doc_id"]: r["text"] for r in given})
    assert sorted(r["doc_id"] for r in got) == sorted({c for c, _, _ in classes.values()})
    texts = {r["doc_id"]: r["text"] for r in given}
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_repeated_passages_go(kept):
    given, got, _ = kept[2]
    want = plain.gone_bytes({r["doc_id"]: r["text"] for r in given}, 400)
    assert len(got) == len(given)
    for r in got:
        # of a character that a cut divides, the other bytes go as well
        assert (r["text"] or "") == plain.rest(*want[r["doc_id"]]).decode("utf-8", "ignore") and r["n_chars"] == len(r["text"] or "")


def test_sources_come_near_their_targets(kept):
    given, got, _ = kept[3]
    size = {r["doc_id"]: len(plain.SPACE.findall(r["text"] or "")) for r in given}
    own, taken = defaultdict(int), defaultdict(int)
    for r in given:
        own[r["source"]] += size[r["doc_id"]]
    for r in got:
        taken[r["source"]] += size[r["doc_id"]]
    copies = Counter(r["doc_id"] for r in got)
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    for s, target in plain.targets(own).items():
        slack = max((size[r["doc_id"]] for r in given if r["source"] == s), default=0)
        assert abs(taken[s] - target) <= slack


def test_pieces_are_the_tokens_in_few_gapless_sequences(kept):
    given, got, _ = kept[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for r in given:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
            want[r["doc_id"], k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= 1.01 * -(-total // 1024) + 1


def test_run_is_the_stages_one_after_the_other(spark, kept):
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, FOLDER + "/").collect()) == key(kept[4][1])
