"""NULLs, empty and long texts, ties, repeated rows, empty tables and extra columns, operator by operator."""

import hashlib
import io
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from ticktide.llm import jaccard, license_scan, mixing, packing, quality_classifier, quality_rules, sharding, suffix_dedup, tokens, topk, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, prefix long, size long"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeü", k=rng.randint(1, 9))) for _ in range(n))


TEXTS = [
    (1, prose(300, 1)), (2, prose(300, 1)), (3, prose(300, 1) + " end"), (4, prose(40, 2)), (4, prose(40, 2)),
    (5, None), (6, ""), (7, " \n\t"), (None, prose(50, 3)), (None, None), (8, "mit " * 500), (9, "Released under the MIT License."),
    (10, prose(60000, 4)), (11, "CC BY-NC x <|endoftext|> é"), (12, prose(150, 5) + prose(100, 1)), (None, prose(300, 1)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 4}", None if k % 5 else 7, 0.5, 1, 2, 3) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables_give_no_rows(spark, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        license_scan.license_spans(none), quality_rules.quality_rules(none), sharding.shard(none), jaccard.near_duplicates(none),
        jaccard.keep_one(none), mixing.mix(none), mixing.repeat(none), packing.pack_documents(none, VOCABULARY),
        suffix_dedup.remove_repeats(none), suffix_dedup.without_repeats(none), warc.round_trip(spark, pages),
        topk.top_k(topk.whole_components(vectors), F.col("vec_id") % 2 == 0),
        quality_classifier.score(none, quality_classifier.Machine()),
    ):
        assert df.collect() == []


def test_license_scan(docs):
    rows = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_spans(docs).collect()}
    for i, t in TEXTS:
        n, n_base, first, last, labels = plain.license_row(t)
        r = rows[i, n]
        starts = [p["start"] for p in r["places"]]
        assert (len(starts), min(starts, default=None), max(starts, default=None)) == (n_base, first, last)
        assert ",".join(sorted({p["label"] for p in r["places"]})) == labels


def test_matching_statistics_are_the_longest_runs():
    rng = random.Random(3)
    templates = [("x", " ".join(rng.choices("abc", k=30))), ("y", " ".join(rng.choices("abcd", k=25)))]
    scanner = license_scan.Scanner((), templates, min_match=1)
    words = [w.encode() for w in rng.choices("abcde", k=400)]
    joined = ["".join(w.decode() for w in t) for t in scanner.templates]
    a, state, length = scanner.automaton, 0, 0
    for i, w in enumerate(words):
        while state and w not in a.next[state]:
            state = a.link[state]
            length = a.length[state]
        state = a.next[state].get(w, 0)
        length = length + 1 if state else 0
        want = max(n for n in range(0, i + 2) if any(b"".join(words[i + 1 - n : i + 1]).decode() in t for t in joined))
        assert length == want
        if length:
            k, end = a.ends[state][0]
            assert scanner.templates[k][end + 1 - length : end + 1] == words[i + 1 - length : i + 1]


def test_spans_bridge_gaps_and_keep_order():
    scanner = license_scan.Scanner((), [("t", "one two three four five six seven eight nine ten")])
    words = b"x one two three four zz five six seven eight nine ten y".split()
    assert scanner.scan(words)[1] == [("t", 0, 1, 12, 1.0)]
    assert scanner.scan(b"eight nine ten one two three".split())[1] == []


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    rows += [(400 + i, [1.0] * 6) for i in range(40)] + [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0] * 6), (504, [2.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = topk.top_k(topk.whole_components(vectors), F.col("vec_id") % 20 == 0, k=10, block=64, chunk=4).collect()
    sound = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in sound if i % 20 == 0):
        others = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(others[:10])}
    assert {tuple(r) for r in got} == want


def test_sharding(docs, spark):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(TEXTS)
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 9)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = sharding.shard(hot).collect()
    sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 24)
    assert sizes.max() - sizes.min() <= 2 * 53
    for k in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_near_duplicates(docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0, r["n_copies"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect()))
    assert got == sorted([
        (False, 1, 1, 3, 1), (False, 2, 1, 3, 1), (True, 0, 1, 3, 1), (False, 3, 1, 1, 1), (False, 4, 4, 2, 0), (False, 4, 4, 2, 0),
        (False, 5, 5, 1, 0), (False, 6, 6, 1, 0), (False, 7, 7, 1, 0), (True, 0, 0, 1, 0), (True, 0, 0, 1, 0), (False, 8, 8, 1, 0),
        (False, 9, 9, 1, 0), (False, 10, 10, 1, 0), (False, 11, 11, 1, 0), (False, 12, 12, 1, 0),
    ])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12] and ids.count(None) == 2


def test_near_copies_in_many_tiles(spark):
    rng = random.Random(9)
    base = prose(200, 8).split()
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard.near_duplicates(df, block=16).collect()}
    assert got == plain.near_classes(texts)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r["u"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_prefixes_are_shortened_to_the_recall_where_that_is_cheapest():
    rng = random.Random(1)
    for recall in (0.5, 0.9, 0.999, 0.9999):
        pairs = {(t, n): rng.random() * 10 ** (7 - n) for t in range(jaccard.TREES) for n in range(1, jaccard.DEPTH + 1)}
        lengths = jaccard.shortened(pairs, 0.8, recall)
        assert jaccard.recall_of(lengths, 0.8) >= recall
        for t in range(jaccard.TREES):  # no tree is shorter than needed by a whole step of all trees
            longer = [min(n + 1, jaccard.DEPTH) for n in lengths]
            assert lengths == [jaccard.DEPTH] * jaccard.TREES or jaccard.recall_of(longer, 0.8) < recall
    dear = {(t, n): 10.0**9 if t < 10 and n < jaccard.DEPTH else 1.0 for t in range(jaccard.TREES) for n in range(1, jaccard.DEPTH + 1)}
    lengths = jaccard.shortened(dear)
    assert set(lengths[:10]) == {jaccard.DEPTH} and jaccard.recall_of(lengths) >= jaccard.RECALL
    assert jaccard.shortened({}, 0.05) == [1] * jaccard.TREES  # as short as can be


def test_sorted_labels_are_tries():
    texts = [prose(30, k) for k in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    values, at = jaccard.sets(*jaccard.shingles(data, offsets))
    labels = jaccard._labels(values, at)
    again = jaccard._labels(np.concatenate([values[at[k] : at[k + 1]] for k in (3, 3)]), np.array([0, at[4] - at[3], 2 * (at[4] - at[3])]))
    assert (again[0] == labels[3]).all() and (again[1] == labels[3]).all()
    one = np.sort(labels[:, 0])
    for n, shift in zip(range(1, jaccard.DEPTH + 1), [jaccard.STEP * (jaccard.DEPTH - n) for n in range(1, jaccard.DEPTH + 1)]):
        runs = one >> np.uint64(shift)
        assert (np.diff(runs.astype(object)) >= 0).all()  # what shares a prefix stands together


def test_near_copies_of_every_similarity_are_found(spark):
    rng = random.Random(17)
    texts, want = {}, set()
    for k in range(2500):
        words = [f"{rng.randrange(10**9):x}" for _ in range(204)]  # 200 runs of five words
        other = list(words)
        for at in rng.sample(range(0, 200, 5), rng.randint(1, 4)):
            other[at] = "changed"
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(other)
        a, b = plain.word_runs(texts[2 * k]), plain.word_runs(texts[2 * k + 1])
        if len(a & b) >= 0.8 * len(a | b):
            want.add(k)
    assert len(want) > 2000
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()}
    for k in range(2500):
        assert got[2 * k + 1] == ((2 * k, 1) if k in want else (2 * k + 1, 0))


def test_quality_rules(docs):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(docs).collect()}
    assert len(quality_rules.quality_rules(docs).collect()) == len(TEXTS)
    assert rows[5, 0]["base_failed"] and not rows[5, 0]["kept"] and rows[5, 0]["word_chars"] == 0
    assert rows[8, 500]["n_repeat_words"] == 500 and rows[8, 500]["base_failed"]
    assert rows[10, 60000]["n_repeat_words"] == 0


def test_warc_round_trip(spark):
    page = [(1, "http://x/ä\r\n", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "u", "<p>é</p>"), (None, "u", "own"), (5, "u", "z" * 900_000), (5, "u", "z" * 900_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(page, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).repartition(2)
    rows = {(r["page_id"], r["payload_bytes"]): r for r in warc.round_trip(spark, pages).collect()}
    tell = lambda *k: (rows[k]["record_type"], rows[k]["refers_to"])
    assert tell(1, 9) == ("revisit", 2) and tell(2, 9) == ("response", None) and tell(None, 9) == ("revisit", 2)
    assert tell(3, 0) == ("revisit", 4) and tell(None, 3) == ("response", None) and tell(5, 900_000) == ("response", None)
    assert rows[2, 9]["payload_digest"] == warc.digest("<p>é</p>".encode()) and rows[1, 9]["payload_digest"] == rows[2, 9]["payload_digest"]


def test_warc_records_one_by_one(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x"), F.repeat(F.col("id").cast("string"), 2000)).alias("html"))
    index = warc.write_bundles(pages, f"file://{tmp_path}").collect()
    assert len(index) == 300 and len({(r["file"], r["frame"]) for r in index}) > 1
    for r in index[::17]:
        got = warc.Reader(f"file://{tmp_path}", r["file"]).record(r["frame"], r["offset"])
        assert got["page_id"] == r["page_id"] and got["payload"] == b"x" + str(r["page_id"]).encode() * 2000
    name = index[0]["file"]
    import zstandard
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / name).read_bytes()), read_across_frames=True).read()
    assert raw.startswith(b"WARC/1.1")


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] + 1e-6 for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r["copies"] for r in rows)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    taken = {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in taken.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 1024


def test_tokens_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(VOCABULARY), tokens.Tokens(VOCABULARY)
    rng = random.Random(1)
    texts = ["".join(rng.choices(list("ab 1.,'é\n\t  　  sS漢🙂") + ["'s", " <|endoftext|>", "  "], k=rng.randint(0, 60))) for _ in range(800)]
    data = [t.encode() for t in texts]
    ids, at = own.of(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_fullest_bin_is_the_best_sum():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(0, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(x) <= counts[x] for x in got)


def test_classifier(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id long, quality int")
    machine = quality_classifier.fit(docs, labels, F.lit(True))
    rows = quality_classifier.score(docs, machine).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.keep(docs, machine, 1e-9).count() == len(TEXTS)
    assert quality_classifier.fit(docs, labels.limit(0), F.lit(True)).bias == 0.0


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality_classifier.Machine(20, 3)
    machine.weight, machine.vector = rng.normal(size=20), rng.normal(size=(20, 3))
    feature, value = np.array([1, 5, 9, 2, 3]), np.array([1.0, 0.5, 2.0, 1.0, 3.0])
    x = quality_classifier.Sparse(np.array([0, 3, 5]), feature, value)
    for row, (s, e) in enumerate(((0, 3), (3, 5))):
        pairs = sum(machine.vector[feature[i]] @ machine.vector[feature[j]] * value[i] * value[j] for i in range(s, e) for j in range(i + 1, e))
        assert machine.logits(x)[row] == pytest.approx(machine.weight[feature[s:e]] @ value[s:e] + pairs)


@pytest.mark.parametrize("width", [60, 400])
def test_suffix_dedup(docs, width):
    keyed = {(i, k): t for k, (i, t) in enumerate(TEXTS)}
    want = sorted((k[0] is None, k[0] or 0, *v) for k, v in plain.removed({k: t for k, t in keyed.items() if len(t or "") < 100_000} | {(10, 12): ""}, width).items())
    small = docs.withColumn("text", F.when(F.length("text") < 100_000, F.col("text")).otherwise(""))
    cut = suffix_dedup.remove_repeats(small, width).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.octet_length("kept").alias("k"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")
    ).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["n"] - r["k"], r["s"], r["h"]) for r in cut) == want


def test_repeats_within_and_across_random_texts(spark):
    rng = random.Random(4)
    passages = ["".join(rng.choices("abü ", k=rng.randint(30, 120))) for _ in range(8)]
    texts = {i: "".join(rng.choice(passages)[rng.randint(0, 20) :] + "".join(rng.choices("xyz", k=rng.randint(0, 40))) for _ in range(rng.randint(0, 6))) for i in range(60)}
    texts |= {100: "ab" * 200, 101: "q" * 300, 102: "q" * 59}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {
        r["doc_id"]: (r["n"], r["n"] - r["k"], r["s"], r["h"])
        for r in suffix_dedup.remove_repeats(df, 60).select(
            "doc_id", F.octet_length("text").alias("n"), F.octet_length("kept").alias("k"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")
        ).collect()
    }
    assert got == plain.removed(texts, 60)


def test_left_texts_are_whole_characters(spark):
    body = "é" * 250
    df = spark.createDataFrame([(1, "aé" + body), (2, body + "z"), (3, None), (4, "k�")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert rows == {1: "a", 2: "z", 3: None, 4: "k�"}


CLASHING = ("spans", "kept", "k1", "k2", "_bytes", "_text_hash", "text_hash", "_n", "_total", "_rows", "_copies", "_nth", "_copy",
            "_size", "_id", "_source", "total", "rows", "words", "copies", "id", "_row", "data")


def test_extra_columns_of_working_names_come_through(docs):
    wide = docs.select("doc_id", "text", "source", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    for f in (jaccard.keep_one, mixing.repeat, suffix_dedup.without_repeats):
        got = f(wide)
        assert got.columns == wide.columns
        for r in got.collect():
            assert all(r[c] == f"own {c}" for c in CLASHING)
    got = suffix_dedup.remove_repeats(wide)
    assert got.columns == [c for c in wide.columns if c not in ("spans", "kept")] + ["spans", "kept"]
    assert all(r["k1"] == "own k1" and bytes(r["kept"]) is not None for r in got.collect())


@pytest.mark.parametrize("texts", [
    [(1, "a b c", "x"), (2, None, "y"), (3, "", "y"), (4, "d", None)], [(1, None, "x"), (2, "", None)], [(None, None, None)],
])
def test_sources_without_words(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    for i, text, source in texts:
        size = len((text or "").split())
        own = sum(len((t or "").split()) for _, t, s in texts if s == source)
        assert (rows[i]["size"], rows[i]["source_size"]) == (size, own)
        if not own:
            assert rows[i]["target"] == 0 and rows[i]["size"] * rows[i]["copies"] == 0
    assert mixing.repeat(df).columns == df.columns
    assert {r["doc_id"] for r in mixing.repeat(df).collect()} <= {i for i, _, _ in texts}


def test_many_spans_in_one_text(spark):
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh ", k=420))
    text = "".join(shared + f"<{rng.random()}>" for _ in range(300))
    row = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    kept = bytes(row["kept"])
    got = len(text), len(text) - len(kept), len(row["spans"]), hashlib.sha256(kept).hexdigest()
    assert got == plain.removed({1: text}, 400)[1] and got[2] >= 300
