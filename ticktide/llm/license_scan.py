"""License scans: matching statistics of whole texts against a generalised suffix automaton of licence wording.

The automaton holds every run of words of every template. A text's words are streamed through it; at each word it
knows the longest run ending there that some template holds (the matching statistic) and where in the templates
that run stands. Runs that can't be lengthened and have ``MIN_MATCH`` words or more are chained, template by template,
in the order of both text and template, over gaps of at most ``MAX_GAP`` words. A chain that covers ``COVERED`` of a
template is a span. Phrases are found in the same pass: a phrase ends where its state is the current one or one of
its suffix links, so exact places need no second search.

Short notices (``TEMPLATES``) and the paragraphs of whole licences and their usual headers (``licence_paragraphs``) have
an automaton each, as the longest run of a header would hide a notice that the header begins with. Every paragraph is
a template of its own and judged by its own coverage. Licences share paragraphs: one whose spans all lie within the
spans of another, which has more, does not count. Where paragraphs of different licences and wordings cover the same
words and none does so wholly, the words that tell them apart are missing, and none of them counts.

A NULL or empty text has no words, places or spans. Repeated rows each give their own row. Memory: the automata
(twice the words of the templates; some 40,000 words) and one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_MATCH = 3
MAX_GAP = 6
COVERED = 0.8

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Wording of common licence notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)

# Licences whose whole texts are in the folder ``licences``.
LICENCES = (
    "agpl-3", "apache-2", "bsd", "cc-by", "cc-by-nc", "cc-by-sa", "cc0", "gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1",
    "lgpl-3", "mit", "mpl-1.1", "mpl-2",
)
SHORT = 8  # words; shorter paragraphs, such as headings, go with the next one

# Usual headers that the texts themselves do not hold.
_OWN = "this program is free software you can redistribute it and or modify it under the terms of the gnu "
HEADERS = (
    ("lgpl-3", _OWN + "lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", _OWN + "general public license version 2 as published by the free software foundation"),
    ("gpl-2", _OWN + "general public license as published by the free software foundation version 2 of the license"),
    ("gpl-3", _OWN + "general public license version 3 as published by the free software foundation"),
    ("gpl-3", _OWN + "general public license as published by the free software foundation version 3 of the license"),
    ("lgpl-2.1", _OWN + "lesser general public license version 2 1 as published by the free software foundation"),
    ("lgpl-3", _OWN + "lesser general public license version 3 as published by the free software foundation"),
    ("agpl-3", _OWN + "affero general public license version 3 as published by the free software foundation"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)

SCHEMA = (
    "doc_id long, n_words long, places array<struct<label:string,start:long,n_words:int>>, "
    "spans array<struct<label:string,template:int,start:long,end:long,score:double>>"
)

# Lower case for A-Z; what is neither a letter, a digit nor beyond ASCII parts words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# A line that names the work and its owner, to be filled in.
_FIELDS = re.compile(r"\s*(<|copyright (\(c\)\s+(19yy\s+)?<|\[yyyy\]))", re.IGNORECASE)


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a licence; those of fewer than ``SHORT`` words stand before the next one, or after the last."""
    out, held = [], ""
    for part in re.split(r"\n\s*\n", text):
        if all(_FIELDS.match(line) for line in part.splitlines()):
            continue
        held += part + "\n"
        if len(folded_words(held.encode())) >= SHORT:
            out.append(held)
            held = ""
    return out[:-1] + [out[-1] + held] if out else [held]


@lru_cache(1)
def licence_paragraphs() -> tuple[tuple[str, str], ...]:
    """(label, paragraph) of all licences, and their usual headers."""
    folder = files(__package__) / "licences"
    return tuple((k, p) for k in LICENCES for p in paragraphs((folder / f"{k}.txt").read_text("utf-8"))) + HEADERS


class SuffixAutomaton:
    """All runs of words of several sequences, in states that share their end places."""

    def __init__(self, sequences: Sequence[Sequence[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, last word) of the state's runs
        for k, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((k, i))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] = sorted({*self.ends[self.link[v]], *self.ends[v]})

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the runs of ``q`` that are no longer than those of ``p`` and ``word``."""
        copy = self._state(self.length[p] + 1, like=q)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def state_of(self, sequence: Sequence[bytes]) -> int:
        v = 0
        for word in sequence:
            v = self.next[v][word]
        return v


class Scanner:
    """Places of phrases and spans of templates in one list of words."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, min_match=MIN_MATCH, max_gap=MAX_GAP, covered=COVERED):
        self.labels = [label for label, _ in templates]
        self.templates = [folded_words(text.encode()) for _, text in templates]
        self.phrases = [(label, folded_words(text.encode())) for text, label in phrases]
        self.min_match, self.max_gap, self.covered = min_match, max_gap, covered
        self.automaton = a = SuffixAutomaton(self.templates + [p for _, p in self.phrases])
        self.known = {w: w for s in self.templates + [p for _, p in self.phrases] for w in s}
        own: dict[int, list[int]] = {}
        for k, (_, p) in enumerate(self.phrases):
            own.setdefault(a.state_of(p), []).append(k)
        self.ending: list[list[int]] = [[] for _ in a.link]  # phrases that may end at a state
        for v in sorted(range(len(a.link)), key=a.length.__getitem__):
            self.ending[v] = own.get(v, []) + (self.ending[a.link[v]] if v else [])

    def scan(self, words: list[bytes]) -> tuple[list[tuple], list[tuple]]:
        a, places, runs = self.automaton, [], []
        state = length = 0
        for i, word in enumerate(map(self.known.get, words)):
            if word is None:
                if length >= self.min_match:
                    runs.append((i - length, length, state))
                state = length = 0
                continue
            if word not in a.next[state] and length >= self.min_match:
                runs.append((i - length, length, state))
            while state and word not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            state = a.next[state].get(word, 0)
            length = length + 1 if state else 0
            for k in self.ending[state]:
                if len(self.phrases[k][1]) <= length:
                    places.append((self.phrases[k][0], i + 1 - len(self.phrases[k][1]), len(self.phrases[k][1])))
        if length >= self.min_match:
            runs.append((len(words) - length, length, state))
        return places, self._chained(runs)

    def _chained(self, runs: list[tuple[int, int, int]]) -> list[tuple]:
        """Spans from runs in text order: each run joins its template's open chain if it lies beyond it in both orders."""
        spans: list[tuple] = []
        open_: dict[int, list[int]] = {}  # template: first word, last word + 1, template's last word + 1, words covered

        def close(k: int) -> None:
            start, end, _, n = open_.pop(k)
            if n >= self.covered * len(self.templates[k]):
                spans.append((self.labels[k], k, start, end, n / len(self.templates[k])))

        for start, length, state in runs:
            at: dict[int, list[int]] = {}
            for k, last in self.automaton.ends[state]:
                if k < len(self.templates):
                    at.setdefault(k, []).append(last + 1 - length)
            for k, firsts in at.items():
                chain = open_.get(k)
                if chain and start - chain[1] <= self.max_gap:
                    # where text or template parts of two runs overlap, the later run counts from where the earlier ends,
                    # unless it covers more alone
                    for first in sorted(firsts):
                        skip = max(0, chain[2] - first, chain[1] - start)
                        if skip < length and skip <= chain[3]:
                            chain[1], chain[2], chain[3] = start + length, first + length, chain[3] + length - skip
                            break
                    else:
                        close(k)
                        open_[k] = [start, start + length, min(firsts) + length, length]
                    continue
                if chain:
                    close(k)
                open_[k] = [start, start + length, min(firsts) + length, length]
        for k in list(open_):
            close(k)
        return sorted(spans, key=lambda s: (s[2], s[1]))


class LicenceScanner:
    """Places of phrases, and spans of short notices and of paragraphs of licences, numbered in this order."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, licences=None, **limits):
        self.notices = Scanner(phrases, templates, **limits)
        self.licences = Scanner((), licence_paragraphs() if licences is None else licences, **limits)
        self.n_notices = len(self.notices.templates)

    def scan(self, words: list[bytes]) -> tuple[list[tuple], list[tuple]]:
        places, spans = self.notices.scan(words)
        found = self._told_apart(self.licences.scan(words)[1])
        more = [(label, k + self.n_notices, *rest) for label, k, *rest in found]
        return places, sorted(spans + more, key=lambda s: (s[2], s[1]))

    def _told_apart(self, spans: list[tuple]) -> list[tuple]:
        """Without licences that other words of the text rule out."""
        at: dict[tuple[int, int], list[tuple]] = {}
        for s in spans:
            at.setdefault(s[2:4], []).append(s)
        clear = []
        for same in at.values():
            wordings = {tuple(self.licences.templates[s[1]]) for s in same}
            if max(s[4] for s in same) == 1 or len(wordings) == 1 or len({s[0] for s in same}) == 1:
                clear += same
        covered: dict[str, set[int]] = {}
        for label, _, start, end, _ in clear:
            covered.setdefault(label, set()).update(range(start, end))
        within = {x for x in covered if any(covered[x] < covered[y] for y in covered)}
        return [s for s in clear if s[0] not in within]


@lru_cache(4)
def _scanner(phrases: tuple, templates: tuple, licences: tuple | None, limits: tuple) -> LicenceScanner:
    """Built once by each Python worker, not by each task."""
    return LicenceScanner(phrases, templates, licences, **dict(limits))


def license_spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, licences=None, **limits) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its words, the places of phrases, the spans of templates.

    ``licences`` are (label, paragraph) pairs, those of :func:`licence_paragraphs` if not given.
    """
    given = (tuple(phrases), tuple(templates), None if licences is None else tuple(licences), tuple(limits.items()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*given)
        for batch in batches:
            n, places, spans = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                found = folded_words(text.as_py() or b"")
                p, s = scanner.scan(found)
                n.append(len(found))
                places.append([dict(zip(("label", "start", "n_words"), x)) for x in p])
                spans.append([dict(zip(("label", "template", "start", "end", "score"), x)) for x in s])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32())]))),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                ],
                ["doc_id", "n_words", "places", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
