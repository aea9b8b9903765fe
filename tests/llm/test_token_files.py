"""Token files against the tokenizer itself, their layout, and reads of parts of them."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_edges import DOCS, TEXTS
from ticktide.llm import token_files
from ticktide.llm.common import slices
from ticktide.llm.tokens import Tokens

WORDS, BYTES = (public_tokenizers.path(f"{v}.json") for v in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_those_of_whole_texts(path):
    rng = random.Random(2)
    parts = ["a", "Bc", "12", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "don't", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "é", "é", "́",
             "Σ", "ΣΑΣ", " ", "　", "中文", "_", "!!", "%%%", "ß", "\x00", "x‍", "İ", "I'll"]
    texts = ["", " ", "".join(rng.choices(parts, k=4000))] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(1500)]
    plain, own = Tokenizer.from_file(path), Tokens(path, remembered=20_000)
    for _ in range(2):  # again with some remembered and some forgotten
        for first, last, data, offsets in slices(pa.array(texts), 3000):
            ids, at = own.of(data, offsets)
            for k in range(last - first):
                assert ids[at[k] : at[k + 1]].tolist() == plain.encode(texts[first + k], add_special_tokens=False).ids, texts[first + k]


def sums(rows):
    plain, at, out = Tokenizer.from_file(WORDS), 0, []
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_round_trip(spark, tmp_path, encoding):
    rows = [(i, t, "en", None, k, 0.5, 1, 2, 3) for k, (i, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("x")).withColumn("part", F.col("n_chars")).repartition(3)
    path = str(tmp_path / encoding)
    token_files.write_tokens(docs, path, WORDS, keep=("lang", "ids", "part", "source"), options=token_files.layout(encoding))
    read = token_files.read_tokens(spark, path)
    got = sorted((tuple(r) for r in token_files.checksums(read).collect()), key=lambda r: r[1])
    key = lambda i: (i is not None, i or 0)
    assert [key(r[0]) for r in got] == sorted(key(r[0]) for r in got)
    at = 0
    for i, start, n, _ in got:
        assert start == at
        at += n
    # documents of one id may stand in either order
    assert sorted((key(r[0]), r[2], r[3]) for r in got) == sorted((key(r[0]), r[2], r[3]) for r in sums(TEXTS))
    own = {r["n_tokens"]: r["meta"] for r in read.collect()}
    assert all(m["lang"] == "en" and m["ids"] == "x" and m["source"] is None for m in own.values())
    some = token_files.read_tokens(spark, path, 3, 8)
    assert {r["doc_id"] for r in some.collect()} == {3, 4, 5, 6, 7, 8}
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in glob.glob(f"{path}/tokens/*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        chunk = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert all(c.has_offset_index for c in chunk.values()) and chunk["doc_id"].has_column_index
        assert ("RLE_DICTIONARY" in chunk["ids.list.element"].encodings) == (encoding == "dictionary")
        assert ("DELTA_BINARY_PACKED" in chunk["ids.list.element"].encodings) == (encoding == "delta")


def test_many_parts_row_groups_and_ties(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40) if i % 3 else 7, " ".join(rng.choices(["one", "two", "three"], k=rng.randint(0, 30))) if i % 3 else "copy") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "many")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(docs, path, WORDS, options=token_files.layout(group_bytes=2048, page_bytes=512, page_rows=20))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(token_files.checksums(token_files.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(s[2:] for s in sums(rows))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/tokens/*.parquet")]
    assert len(files) > 1 and max(f.num_row_groups for f in files) > 1


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(none, str(tmp_path / "none"), WORDS)
    assert token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "none"))).collect() == []


def test_unknown_encoding():
    with pytest.raises(ValueError):
        token_files.layout("plain")
