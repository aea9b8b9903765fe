"""Every query of the operators on the small tables, against SQL or plain versions."""

import os
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import compare
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows_of(spark, name):
    return entry_points.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", ["op2_exact_topk", "op5_quality_rules", "op6_warc", "op13_hard_negatives"])
def test_query_agrees_with_sql(spark, name):
    ok, note = compare.compare(spark, compare.database(FOLDER), FOLDER, name)
    assert ok, note


def test_license_scan(spark, docs):
    rows = rows_of(spark, "op1_license_scan")
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.license_row(docs[r["doc_id"]]["text"])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert any("gpl-3" in r["labels"] for r in rows)


def test_sharding(spark, docs):
    rows = rows_of(spark, "op3_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(bytes_) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_.values()) - min(bytes_.values()) <= 2 * max(r["size"] for r in rows)


def test_near_duplicates(spark, docs):
    want = plain.near_classes({k: r["text"] for k, r in docs.items()})
    assert {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in rows_of(spark, "op4_ngram_jaccard")} == want


def test_mixing(spark, docs):
    rows = rows_of(spark, "op7_mixing")
    size = {k: len(plain.SPACE.findall(r["text"] or "")) for k, r in docs.items()}
    per_source = defaultdict(int)
    for k, r in docs.items():
        per_source[r["source"]] += size[k]
    target = plain.targets(per_source)
    taken = defaultdict(int)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per_source[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in per_source:
        assert taken[s] == pytest.approx(target[s], rel=0.01)
    again = {(r["doc_id"], r["taken"]) for r in rows_of(spark, "op7_mixing")}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_packing(spark, docs):
    import numpy as np

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op8_packing"):
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for k, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[k]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
        at = 0
        for i, r in enumerate(own):
            assert r["start"] == at and (r["length"] == 1024 or i == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= 1.002 * -(-total // 1024) + 1


def test_quality_classifier(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = rows_of(spark, "op9_quality_classifier")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert plain.area([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) > 0.95


def test_suffix_dedup(spark, docs):
    want = plain.removed({k: r["text"] for k, r in docs.items()}, 400)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, "op10_suffix_dedup")}
    assert got == want


def test_token_output(spark, docs):
    import numpy as np

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, set()
    for k in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[k]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.add((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {tuple(r) for r in rows_of(spark, "op12_token_output")} == want


def test_whitening(spark):
    import numpy as np

    from tests.llm.test_whitening import check

    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").filter("embedding is not null").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in vectors], np.float32).astype(float)).astype(np.int64) + 1_000_000
    check(rows_of(spark, "op11_whitening"), [r["vec_id"] for r in vectors], x)
