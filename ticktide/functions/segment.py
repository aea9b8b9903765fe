"""Words of text that is written without blanks, from a caller's word list.

A stretch of one script is cut into words of the list such that as little as possible lies outside all words, then into as
few words as possible, then with the longest word first. Cuts never part a letter from its marks, nor a vowel that is
written before its letter. What lies outside all words and side by side is one word. The list is matched as it is, so
text and list should be cleaned alike; it goes to every task, and so should be a dictionary and not a corpus.

NULL stays NULL, an empty text empty; without a word list a stretch is one word. Other text is left as it is, with a blank
between it and a stretch. Time grows with the length of the text and of the longest word.

Many stretches are cut together: their words are found by steps through the list's tree at all places at once. A word
that no other overlaps is taken as it is; a tangle of overlapping words is cut by itself, once for all places of it
that a task remembers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Thai letters, vowels and marks without its digits; vowels written before their letter; vowels and marks
# that belong to the letter before, and marks of other scripts.
THAI = "[ก-๎]"
_UNIT = re.compile("(?s)[เ-ไ]?.[ะ-ฺๅ็-๎̀-ͯ]*")
_BEFORE = ((0x0E40, 0x0E44),)
_MARKS = ((0x0E30, 0x0E3A), (0x0E45, 0x0E45), (0x0E47, 0x0E4E), (0x0300, 0x036F))

#: Characters that are cut together; a longer stretch is taken whole.
TOGETHER = 1 << 17
#: Cells of a full table of the tree; beyond, its edges are searched for.
CELLS = 1 << 22
#: Tangles that a task remembers, and the longest one of them.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 64

_END = ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _within(codes: np.ndarray, ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([(codes >= low) & (codes <= high) for low, high in ranges])


def _nested(words: Iterable[str]) -> dict:
    """Nested dictionaries by unit; ``_END`` marks the end of a word."""
    root: dict = {}
    for word in words:
        node = root
        for unit in _UNIT.findall(word):
            node = node.setdefault(unit, {})
        node[_END] = None
    return root


def _ends(tangle: str, nested: dict) -> tuple[int, ...]:
    """Where the words begin and end that the best cut of ``tangle`` is made of."""
    units = _UNIT.findall(tangle)
    n = len(units)
    # from the end: a unit outside all words costs more than all words together
    cost, take = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        least, node = cost[i + 1] + n + 1, nested
        for j in range(i, n):
            node = node.get(units[j])
            if node is None:
                break
            if _END in node and cost[j + 1] + 1 <= least:
                least, take[i] = cost[j + 1] + 1, j + 1 - i
        cost[i] = least
    found, i, at = [], 0, 0
    while i < n:
        end = at + sum(map(len, units[i : i + (take[i] or 1)]))
        if take[i]:
            found += [at, end]
        i, at = i + (take[i] or 1), end
    return tuple(found)


class _Tree:
    """The words as a tree of characters; a node's edge leads to the child's number, or to -1."""

    def __init__(self, words: Sequence[str]):
        self.letters = np.unique(_codes("".join(words)))
        self.width = len(self.letters) + 1  # and one for all other characters
        self.longest = max(map(len, words), default=0)
        self.nested, self.remembered = _nested(words), {}
        edges: dict[int, int] = {}
        ends, nodes = [], 1
        for word in words:
            node = 0
            for letter in self._letter(_codes(word)).tolist():
                key = node * self.width + letter
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                node = edges[key]
            ends.append(node)
        self.ends = np.zeros(nodes, bool)
        self.ends[ends] = True
        self.keys = np.array(sorted(edges), np.int64)
        self.children = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.table = None
        if nodes * self.width <= CELLS:
            self.table = np.full(nodes * self.width, -1, np.int32)
            self.table[self.keys] = self.children

    def _letter(self, codes: np.ndarray) -> np.ndarray:
        """Number of every character among the tree's letters."""
        if not len(self.letters):
            return np.zeros(len(codes), np.int64)
        at = np.searchsorted(self.letters, codes).clip(0, len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, len(self.letters))

    def _child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = node * self.width + letter
        if self.table is not None:
            return self.table[key].astype(np.int64)
        at = np.searchsorted(self.keys, key).clip(0, len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def ends_in(self, tangle: str) -> tuple[int, ...]:
        """As :func:`_ends`, remembered while there is room."""
        ends = self.remembered.get(tangle)
        if ends is None:
            ends = _ends(tangle, self.nested)
            if len(tangle) <= REMEMBERED_LENGTH:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[tangle] = ends
        return ends

    def found(self, codes: np.ndarray, starts: np.ndarray, limit: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word that stands at one of ``starts``, before its ``limit``, and ends where a unit does."""
        out_s, out_e = [], []
        if not self.longest:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters, node = self._letter(codes), np.zeros(len(starts), np.int64)
        for depth in range(self.longest):
            inside = starts + depth < limit
            starts, limit, node = starts[inside], limit[inside], node[inside]
            node = self._child(node, letters[starts + depth])
            some = node >= 0
            starts, limit, node = starts[some], limit[some], node[some]
            if not len(starts):
                break
            word = self.ends[node] & unit[starts + depth + 1]
            out_s.append(starts[word])
            out_e.append(starts[word] + depth + 1)
        return np.concatenate(out_s or [starts]), np.concatenate(out_e or [starts])


def _units(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where units begin (as ``_UNIT`` finds them in every stretch), and one more at the end of all."""
    at = np.arange(len(codes))
    first = np.zeros(len(codes), bool)
    first[firsts] = True
    before = _within(codes, _BEFORE)
    # of vowels side by side, each second one is what the one before it is written before
    opens = before & (first | ~np.append(False, before[:-1]))
    place = at - np.maximum.accumulate(np.where(opens | ~before, at, 0))
    starts = np.where(before, place % 2 == 0, ~_within(codes, _MARKS))
    waits = before & starts
    starts[1:] &= ~waits[:-1]
    starts[firsts] = True
    return np.append(starts, True)


def _cut(stretches: Sequence[str], tree: _Tree) -> list[list[str]]:
    """Words of every stretch; none is empty."""
    codes = _codes("".join(stretches))
    sizes = np.array([len(x) for x in stretches])
    lasts = np.cumsum(sizes)
    unit = _units(codes, lasts - sizes)
    starts = np.flatnonzero(unit[:-1])
    s, e = tree.found(codes, starts, np.repeat(lasts, sizes)[starts], unit)
    text = "".join(stretches)
    cuts = np.zeros(len(codes) + 1, bool)
    cuts[lasts - sizes] = True
    # no word lies across the ends of a tangle
    over = np.cumsum(np.bincount(s + 1, minlength=len(codes) + 1) - np.bincount(e, minlength=len(codes) + 1))
    bounds = np.flatnonzero(unit & (over == 0))
    first = np.zeros(len(codes) + 1, bool)
    first[bounds] = True
    inside = (np.cumsum(first) - 1)[s]
    held = np.bincount(inside, minlength=len(bounds))
    alone = held[inside] == 1
    cuts[s[alone]] = cuts[e[alone]] = True
    several = np.flatnonzero(held > 1)
    found = [tree.ends_in(text[a:b]) for a, b in zip(bounds[several].tolist(), bounds[several + 1].tolist())]
    at = np.repeat(bounds[several], [len(x) for x in found])
    cuts[at + np.fromiter(chain.from_iterable(found), np.int64, len(at))] = True
    at = np.flatnonzero(cuts[:-1])
    ends = np.append(at[1:], len(codes))
    words = [text[a:b] for a, b in zip(at.tolist(), ends.tolist())]
    place = np.append(np.searchsorted(at, lasts - sizes), len(at)).tolist()
    return [words[a:b] for a, b in zip(place[:-1], place[1:])]


def segment(text: Column, words: Sequence[str], script: str = THAI) -> Column:
    """``text`` with one blank between the words of its stretches of ``script`` (a character class); filters for words can follow."""
    listed, pattern = sorted({w for w in words if w}), f"{script}+"

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree, stretch = _Tree(listed), re.compile(pattern)

        def apart(values: list[str | None], found: list[list[re.Match]]) -> list[str | None]:
            given = [m.group() for each in found for m in each]
            words, out = iter(_cut(given, tree) if given else []), []
            for value, each in zip(values, found):
                if not each:
                    out.append(value)
                    continue
                parts, at = [], 0
                for m in each:
                    parts += [value[at : m.start()].strip(" "), *next(words)]
                    at = m.end()
                out.append(" ".join(x for x in [*parts, value[at:].strip(" ")] if x))
            return out

        for batch in batches:
            out, values, found, held = [], [], [], 0
            for value in batch:
                value = value if isinstance(value, str) else None
                values.append(value)
                found.append([] if value is None else list(stretch.finditer(value)))
                held += len(value or "")
                if held >= TOGETHER:
                    out += apart(values, found)
                    values, found, held = [], [], 0
            yield pd.Series(out + apart(values, found), index=batch.index, dtype=object)

    return cut(text)
