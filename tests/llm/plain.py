"""Plain versions of the operators, slow and without Spark, to hold their results against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_row(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels."""
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = FOLDED.findall(lower)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def gone_bytes(texts: dict, width: int) -> dict:
    """Bytes and the mark of removed ones, by key."""
    data = {k: (t or "").encode() for k, t in texts.items()}
    starts = Counter(d[s : s + width] for d in data.values() for s in range(len(d) - width + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for s in range(len(d) - width + 1):
            if starts[d[s : s + width]] > 1:
                gone[s : s + width] = b"\x01" * width
        out[k] = d, bytes(gone)
    return out


def rest(d: bytes, gone: bytes) -> bytes:
    return bytes(b for b, g in zip(d, gone) if not g)


def removed(texts: dict, width: int) -> dict:
    """n_bytes, n_removed, n_spans and hash of the rest, by key."""
    return {
        k: (len(d), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(rest(d, gone)).hexdigest())
        for k, (d, gone) in gone_bytes(texts, width).items()
    }


def targets(per_source: dict) -> dict:
    """Words that each source shall have: shared by weights 1, 2, 3, at most three times its own, the excess shared again."""
    sources = sorted(per_source, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = sum(per_source.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * per_source[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * per_source[s]
            open_.remove(s)


def word_runs(text: str | None, n: int = 5) -> frozenset:
    words = SPACE.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near_classes(texts: dict, least: float = 0.8) -> dict:
    """class id, copies and links by id: ids must differ."""
    by_set = defaultdict(list)
    for k, t in texts.items():
        by_set[word_runs(t)].append(k)
    empty = by_set.pop(frozenset(), [])
    index = defaultdict(set)
    for s in by_set:
        for r in s:
            index[r].add(s)
    parent = {s: s for s in by_set}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    links = Counter()
    for s in by_set:
        common = Counter(o for r in s for o in index[r])
        for o, n in common.items():
            if o is not s and n >= least * (len(s) + len(o) - n) - 1e-9:
                links[s] += 1
                parent[root(o)] = root(s)
    lowest = defaultdict(list)
    for s, ids in by_set.items():
        lowest[root(s)] += ids
    out = {k: (min(lowest[root(s)]), len(ids), links[s]) for s, ids in by_set.items() for k in ids}
    return out | {k: (k, 1, 0) for k in empty}


def area(scores, truth) -> float:
    """Chance that a row of label 1 scores above one of label 0."""
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in order[i:j]:
            ranks[k] = (i + j + 1) / 2
        i = j
    n1 = sum(truth)
    return (sum(r for r, y in zip(ranks, truth) if y) - n1 * (n1 + 1) / 2) / (n1 * (len(truth) - n1))
