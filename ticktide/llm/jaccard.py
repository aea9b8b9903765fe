"""N-gram Jaccard join: MinHash LSH forest with prefixes shortened to a target recall, then exact verification.

A text is the set of its runs of WORDS words (fewer words: one run of all). In each of TREES trees it has a label of
DEPTH minimum hashes, packed into 64 bits so that sorted labels are the tree's prefix trie: BITS of the first hash, then
STEP of each further one. All trees start at full depth. As long as a pair exactly at the threshold would share a prefix
in some tree with less than the target recall, one tree's prefixes are shortened by a hash: the tree where that raises
the recall most for the pairs it adds, as counted over all nodes of the tries. The counts steer the order only; the recall
is that of the lengths reached, whatever the data. No text's partners are cut off by number. Texts with equal
sets are one member, whatever their number.

Members below one prefix form a bucket. Buckets are dealt in tiles: members fall into blocks of some BLOCK, and each
pair of blocks is one task's group, so no bucket is gathered whole. A pair belongs to the first tree that it shares,
which both sides know from their prefixes, so it is verified once. A first pass over prefixes alone finds which
members have a pair in which tile; only those get their sets sent. Verification counts common runs exactly; a tile
returns, for each member, its number of links and one edge towards the smallest member it is tied to, never its pairs.
Classes are the connected components of these edges, found by star contraction in Spark.

A NULL or empty text has no runs and is a class of its own without links, even beside others like it. A class id is
the smallest doc_id of the class, NULL ids left out. Repeated rows count as copies. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import BROADCAST_ROWS, ROW, RangeHash, boxed, checked, mixed, slices, word_bounds, written

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
BLOCK = 512
BITS, STEP = 24, 8

_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 1 << 63, TREES * DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, TREES * DEPTH).astype(np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def recall_of(lengths: list[int], threshold: float = THRESHOLD) -> float:
    """Chance that a pair of similarity ``threshold`` shares a prefix of the tree's length in some tree."""
    return 1 - math.prod(1 - threshold**length for length in lengths)


def shortened(pairs: Mapping[tuple[int, int], float], threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Prefix length of each tree, shortened from ``depth`` until ``recall`` is reached or all are 1.

    ``pairs`` tells how many pairs share a prefix, by tree and length.
    """
    lengths = [depth] * trees

    def worth(tree: int) -> float:
        length = lengths[tree]
        gain = math.log(1 - threshold**length) - math.log(1 - threshold ** (length - 1)) if threshold < 1 else 1.0
        return gain / (1 + pairs.get((tree, length - 1), 0) - pairs.get((tree, length), 0))

    while recall_of(lengths, threshold) < recall and max(lengths) > 1:
        best = max((t for t in range(trees) if lengths[t] > 1), key=lambda t: (worth(t), -t))
        lengths[best] -= 1
    return lengths


def shifts(lengths: list[int], depth: int = DEPTH) -> list[int]:
    """Bits of a label below a prefix of each tree's length."""
    return [STEP * (depth - length) for length in lengths]


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words of all texts, with repeats, and the number of runs before each text."""
    start, end, at = word_bounds(data, offsets)
    word = RangeHash(data).of(start, end)
    n = np.diff(at)
    per_text = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    before = np.concatenate(([0], np.cumsum(per_text)))
    first = np.repeat(at[:-1] - before[:-1], per_text) + np.arange(before[-1])
    last = np.repeat(at[1:], per_text)
    run = np.zeros(len(first), np.uint64)
    padded = np.concatenate((word, np.zeros(words, np.uint64)))
    for k in range(words):
        run += np.where(first + k < last, padded[first + k] * _PLACE[k], np.uint64(0))
    return mixed(run), before


def sets(runs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of each text, ascending, and the number before each text."""
    out = [np.unique(runs[s:e]) for s, e in zip(before[:-1], before[1:])]
    return np.concatenate(out) if out else runs, np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64)))


def _digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name the set of different values from at[k] to at[k + 1]."""
    out = []
    for salt in (np.uint64(0x51ED2701), np.uint64(0xA24BAED4963EE407)):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(values + salt), dtype=np.uint64)))
        out.append((sums[at[1:]] - sums[at[:-1]]).astype(np.int64))
    return out[0], out[1]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _labels(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every text, none of them without runs, its label in each tree."""
    out = np.empty((len(at) - 1, TREES), np.uint64)
    for tree in range(TREES):
        label = np.zeros(len(at) - 1, np.uint64)
        for k in range(DEPTH):
            low = mixed(np.minimum.reduceat(values * _MULTIPLY[tree * DEPTH + k] + _ADD[tree * DEPTH + k], at[:-1]))
            bits = np.uint64(STEP if k else BITS)
            label = (label << bits) | (low >> (np.uint64(64) - bits))
        out[:, tree] = label
    return out


_SIGNED = "doc_id long, text_hash long, s1 long, s2 long, n int, labels array<long>"


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): name and size of its set, and its label in each tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                values, at = sets(*shingles(data, offsets, words))
                n = np.diff(at)
                full = n > 0
                labels = np.zeros((len(n), TREES), np.uint64)
                if full.any():
                    labels[full] = _labels(values, np.append(at[:-1][full], at[-1]))
                s1, s2 = _digests(values, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TREES), pa.array(_signed(labels.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64())[first:last], batch.column(2)[first:last], pa.array(s1), pa.array(s2), pa.array(n.astype(np.int32)), lists],
                    ["doc_id", "text_hash", "s1", "s2", "n", "labels"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, _SIGNED)


def trie_pairs(members: DataFrame) -> dict[tuple[int, int], float]:
    """Pairs that share a prefix, by tree and length, counted over all nodes."""
    each = members.select(F.posexplode("labels").alias("tree", "label"))
    lengths = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.shiftrightunsigned("label", STEP * (DEPTH - n)).alias("prefix")) for n in range(1, DEPTH + 1)]))
    sizes = each.select("tree", lengths.alias("node")).groupBy("tree", "node.length", "node.prefix").agg(F.count("*").cast("double").alias("n"))
    # a row per tree and length
    found = sizes.filter("n > 1").groupBy("tree", "length").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    return {(r["tree"], r["length"]): r["pairs"] for r in found}


def prefixes(members: DataFrame, lengths: list[int]) -> DataFrame:
    """``members`` with the hash of its shortened prefix in each tree in the place of labels."""
    cut = ", ".join(map(str, shifts(lengths)))
    named = F.expr(f"transform(labels, (x, tree) -> xxhash64(tree, shiftrightunsigned(x, array({cut})[tree])))")
    return members.withColumn("prefixes", named).drop("labels")


SET = ["s1", "s2"]
TILE = ["prefix", "low", "high"]


def _tiled(batches: Iterator[pa.RecordBatch], key: int = 3) -> Iterator[pa.RecordBatch]:
    """One batch per tile, from batches in order of the first ``key`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(key)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            now = tuple(keys[s])
            if held and now != last:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [flat[s:e] for s, e in zip(at[:-1], at[1:])]


def _own_pairs(tile: pa.RecordBatch, prefix: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that meet in this tile, and in no earlier tree; ``tile`` has block and prefixes."""
    block = tile.column("block").to_numpy()
    prefixes = tile.column("prefixes").flatten().to_numpy().reshape(len(block), -1)
    tree = int(np.flatnonzero(prefixes[0] == prefix)[0])
    a = np.flatnonzero(block == low)
    b = a if low == high else np.flatnonzero(block == high)
    own = np.ones((len(a), len(b)), bool)
    for t in range(tree):
        own &= prefixes[a, t][:, None] != prefixes[b, t][None, :]
    if low == high:
        own &= a[:, None] < b[None, :]
    i, j = np.nonzero(own)
    return a[i], b[j]


def _near_sizes(n: np.ndarray, i: np.ndarray, j: np.ndarray, least: Fraction) -> np.ndarray:
    """Pairs whose sizes allow the threshold."""
    return np.minimum(n[i], n[j]) * least.denominator >= np.maximum(n[i], n[j]) * least.numerator


def _common(members: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common values of every pair of members; few pairs one by one, many as products of 0/1 matrices."""
    sizes = np.array([len(m) for m in members])
    one_by_one = (sizes[i] + sizes[j]).sum() * 2e-8 + len(i) * 1e-5
    if one_by_one > 0.02:
        used = np.unique(np.concatenate((i, j)))
        values, where, times = np.unique(np.concatenate([members[k] for k in used]), return_inverse=True, return_counts=True)
        shared = times > 1
        column = np.cumsum(shared) - 1
        width = int(shared.sum())
        if len(used) ** 2 * width * 1e-10 < one_by_one:
            row = np.repeat(np.arange(len(used)), sizes[used])
            keep = shared[where]
            row, where = row[keep], column[where[keep]]
            total = np.zeros((len(used), len(used)), np.float32)  # whole numbers below 2**24, or sums of such
            step = 8192
            order = np.argsort(where, kind="stable")
            row, where = row[order], where[order]
            bounds = np.searchsorted(where, np.arange(0, width + step, step))
            wide = total.astype(np.float64)
            for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
                part = np.zeros((len(used), min(step, width - k * step)), np.float32)
                part[row[s:e], where[s:e] - k * step] = 1
                wide += part @ part.T
            place = np.searchsorted(used, np.arange(len(members)))
            return wide[place[i], place[j]].astype(np.int64)
    return np.array([len(np.intersect1d(members[a], members[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each row is tied to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def buckets(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (s1, s2, n, prefixes) of every prefix that two or more share, once for each tile they are in."""
    each = members.select(*SET, "n", "prefixes", F.explode("prefixes").alias("prefix"))
    shared = written(each.groupBy("prefix").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    blocks = F.ceil(F.col("size") / float(block)).cast("int")
    # two numbers a row
    placed = each.join(checked(shared, 4 * BROADCAST_ROWS), "prefix").withColumn("block", F.pmod(F.xxhash64(*SET), blocks).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "prefix", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *SET, "n", "prefixes"
    )


def _by_tile(df: DataFrame) -> DataFrame:
    return df.repartition(*TILE).sortWithinPartitions(*TILE, *SET)


def candidates(tiles: DataFrame, least: Fraction) -> DataFrame:
    """TILE, block and SET of the members that have a pair of their own in a tile."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiled(batches):
            prefix, low, high = (tile.column(k)[0].as_py() for k in range(3))
            i, j = _own_pairs(tile, prefix, low, high)
            near = _near_sizes(tile.column("n").to_numpy().astype(np.int64), i, j, least)
            rows = np.unique(np.concatenate((i[near], j[near])))
            if len(rows):
                yield tile.take(pa.array(rows)).select(["prefix", "low", "high", "block", "s1", "s2"])

    return _by_tile(tiles).mapInArrow(find, "prefix long, low int, high int, block int, s1 long, s2 long")


def links(tiles: DataFrame, least: Fraction) -> DataFrame:
    """s1, s2, n_links and a tied member t1, t2, per tile and linked member; ``tiles`` has the members' sets as well."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiled(batches):
            prefix, low, high = (tile.column(k)[0].as_py() for k in range(3))
            s1, s2 = tile.column("s1").to_numpy(), tile.column("s2").to_numpy()
            same = np.zeros(len(s1), bool)  # a text that comes in several rows brings its set more than once
            same[1:] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
            if same.any():
                tile = tile.filter(pa.array(~same))
                s1, s2 = tile.column("s1").to_numpy(), tile.column("s2").to_numpy()
            i, j = _own_pairs(tile, prefix, low, high)
            n = tile.column("n").to_numpy().astype(np.int64)
            near = _near_sizes(n, i, j, least)
            i, j = i[near], j[near]
            common = _common(_lists(tile.column("members")), i, j)
            linked = common * least.denominator >= (n[i] + n[j] - common) * least.numerator
            i, j = i[linked], j[linked]
            if len(i):
                times = np.bincount(np.concatenate((i, j)), minlength=len(n))
                root = _roots(len(n), i, j)
                rows = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1[rows]), pa.array(s2[rows]), pa.array(times[rows].astype(np.int64)), pa.array(s1[root[rows]]), pa.array(s2[root[rows]])],
                    ["s1", "s2", "n_links", "t1", "t2"],
                )

    return _by_tile(tiles).mapInArrow(verify, "s1 long, s2 long, n_links long, t1 long, t2 long")


def components(edges: DataFrame) -> DataFrame:
    """u and the smallest member ``root`` of its component, from edges (u, v): alternating large and small stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        tied = both.join(low, "u")
        own = tied.filter("v > u") if large else tied.filter("v <> m")
        out = own.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (out if large else out.unionByName(low.select("u", F.col("m").alias("v")))).filter("u <> v").distinct()

    def print_of(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.filter("u <> v").distinct(), "edges")
    seen = print_of(now)
    while True:
        now = written(star(star(now, True), False), "edges")
        new = print_of(now)
        if new == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = new


def _first() -> Column:
    """The row of a group that stands for it: rows with an id first, then by id and text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Name of its set for every row, and for sets with copies or links: n_copies, n_links and the class's ``first`` row."""
    least = Fraction(str(threshold))
    signed = written(signatures(docs, words), "signed")
    labelled = written(
        signed.filter("n > 0").groupBy(*SET).agg(
            F.first("n").alias("n"), F.first("labels").alias("labels"), F.count("*").alias("n_copies"), _first().alias("first")
        ),
        "members",
    )
    members = prefixes(labelled, shortened(trie_pairs(labelled), threshold))
    wanted = written(candidates(buckets(members, block), least), "candidates")
    tiles = wanted.groupBy(*SET).agg(F.collect_list(F.struct(*TILE, "block")).alias("tiles"))
    asked = tiles.join(members, SET).select(*SET, "n", "prefixes", "tiles", "first.text_hash", "first.doc_id")
    found = written(links(_with_sets(docs, written(asked, "asked"), words), least), "links")
    name = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    tied = components(found.select(name("s1", "s2").alias("u"), name("t1", "t2").alias("v")))
    tied = written(tied.select(F.col("u.a").alias("s1"), F.col("u.b").alias("s2"), "root"), "components")
    counted = found.groupBy(*SET).agg(F.sum("n_links").alias("n_links"))
    # all other sets are classes of one row
    some = members.join(counted, SET, "left").join(tied, SET, "left").filter("n_copies > 1 or n_links is not null").select(
        *SET, "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first", F.coalesce("root", name("s1", "s2")).alias("root")
    )
    some = written(some, "classes")
    lowest = some.groupBy("root").agg(F.min("first").alias("first"))
    return signed, written(some.drop("first").join(lowest, "root").select(*SET, "n_copies", "n_links", "first"), "class_rows")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_copies (rows with an equal set) and n_links (other sets at the threshold) of every row."""
    signed, grouped = classes(docs, threshold, words, block)
    rows = signed.select("doc_id", *SET, (F.col("n") > 0).alias("full")).join(checked(grouped), SET, "left")
    tells = F.col("full") & F.col("first").isNotNull()
    return rows.select(
        "doc_id",
        F.when(tells, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(tells, F.col("n_copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.when(tells, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id; rows without words stay.

    All columns are returned as they are, whatever their names.
    """
    signed, grouped = classes(docs, threshold)
    own = signed.filter("n > 0").join(checked(grouped), SET)
    at = lambda c: F.col(f"first.{c}")
    gone = own.filter(~(F.col("doc_id").eqNullSafe(at("doc_id")) & (F.col("text_hash") == at("text_hash"))))
    key = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    gone = written(gone.select(*key).distinct(), "dropped")
    again = written(signed.filter("n > 0").groupBy(*key).count().filter("count > 1").select("_id", "_hash"), "repeated_rows")
    rows = boxed(docs, "doc_id").withColumn("text_hash", F.xxhash64(F.col(f"{ROW}.text")))

    def match(side: DataFrame, how: str) -> DataFrame:
        side = checked(side)
        return rows.join(side, rows["doc_id"].eqNullSafe(side["_id"]) & (rows["text_hash"] == side["_hash"]), how)

    kept = match(gone, "left_anti")
    if again.limit(1).count():  # rows alike in id and text: only they are shuffled
        rows = kept
        kept = match(again, "left_anti").unionByName(match(again, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return kept.select(f"{ROW}.*")


def _with_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """The tiles of every asked member with its set, from one of the rows that hold its text."""
    out = "prefix long, low int, high int, block int, s1 long, s2 long, n int, prefixes array<long>, members array<long>"
    names = [f.split()[0] for f in out.split(", ")]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text")):
                own = batch.slice(first, last - first)
                values, at = sets(*shingles(data, offsets, words))
                s1, s2 = _digests(values, at)
                # a row may hold another text under the same id and hash
                rows = np.flatnonzero((own.column("s1").to_numpy() == s1) & (own.column("s2").to_numpy() == s2))
                tiles = own.column("tiles").take(pa.array(rows))
                each = pa.array(np.repeat(rows, tiles.value_lengths().to_numpy()))
                members = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(_signed(values)))
                cells = [*tiles.flatten().flatten(), *(own.column(c).take(each) for c in ("s1", "s2", "n", "prefixes")), members.take(each)]
                yield pa.RecordBatch.from_arrays(cells, names)

    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_hash"))
    same_id = F.col("id").eqNullSafe(F.col("doc_id"))
    at = checked(asked)
    return keyed.join(at, (keyed["text_hash"] == at["text_hash"]) & same_id).select(
        "text", "s1", "s2", "n", "prefixes", "tiles"
    ).mapInArrow(load, out)
