"""Pairs below shared prefixes are counted over all nodes."""

import random
from collections import Counter

from ticktide.llm import jaccard


def test_pairs_of_all_nodes(spark):
    rng = random.Random(4)
    cut = [jaccard.STEP * (jaccard.DEPTH - n) for n in range(1, jaccard.DEPTH + 1)]
    base = [[rng.getrandbits(64) for _ in range(jaccard.TREES)] for _ in range(30)]
    # each differs from its base below some length of every prefix
    labels = [[x ^ (rng.getrandbits(64) & ((1 << rng.choice(cut)) - 1)) for x in rng.choice(base)] for _ in range(300)]
    signed = [([x - (1 << 64) if x >> 63 else x for x in row],) for row in labels]
    got = jaccard.trie_pairs(spark.createDataFrame(signed, "labels array<long>"))
    nodes = Counter((t, n, x >> cut[n - 1]) for row in labels for t, x in enumerate(row) for n in range(1, jaccard.DEPTH + 1))
    want = Counter()
    for (tree, length, _), n in nodes.items():
        want[tree, length] += n * (n - 1) // 2
    assert got == {k: v for k, v in want.items() if v}


def test_no_members(spark):
    assert jaccard.trie_pairs(spark.createDataFrame([], "labels array<long>")) == {}
