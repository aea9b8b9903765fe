"""Token ids of whole texts from public vocabularies, each different stretch of text tokenized once per worker.

Texts are cut at single spaces before ordinary characters, around single line feeds between them, and between an ASCII
letter or digit and ASCII punctuation other than the apostrophe, where neither of the vocabularies in use joins tokens:
both split classes of characters, the byte-level one takes a space to the word behind it, the word-level one drops
white space. New stretches are tokenized
in rows of many with the end mark between them; ids are put together from what is remembered. The memory is bounded by
bytes and forgets its older half when it is full, which costs time and never changes an id.
"""

from __future__ import annotations

import numpy as np

from ticktide.llm.common import RangeHash

#: Bytes of ids, hashes and places that a worker remembers.
REMEMBERED_BYTES = 24 << 20
#: Bytes of text that are looked up at once; a longer text is taken whole.
TEXT_BYTES = 512 << 10
#: Bytes of new stretches that one call of the tokenizer takes.
CALL_BYTES = 64 << 10
MARK = b"<|endoftext|>"  # Fixed value: a special token of both vocabularies, as the next line.
SPECIAL = b"<|"
# First bytes of white space beyond ASCII, and of marks that go with the character before them.
_UNSAFE = np.zeros(256, bool)
_UNSAFE[:0x21] = True
_UNSAFE[[0x7F, 0xC2, 0xCC, 0xCD, 0xE1, 0xE2, 0xE3]] = True
_PRINTED, _WORD, _POINT = (np.zeros(256, bool) for _ in range(3))
_PRINTED[0x21:0x7F] = True
_WORD[[b for b in range(0x80) if chr(b).isalnum()]] = True
_POINT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


def _gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges of ``values`` one after the other."""
    before = np.cumsum(length) - length
    return values[np.repeat(start - before, length) + np.arange(int(length.sum()))]


class Tokens:
    """Ids of texts, from remembered ids of the stretches between spaces."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id = self.tokenizer.token_to_id(MARK.decode())
        self.remembered = remembered
        self._forget(0)

    def _forget(self, first: int) -> None:
        """Keep what was learned from number ``first`` on; 0 forgets all."""
        if not first:
            self.hashes = np.zeros(0, np.uint64)  # sorted
            self.rank = np.zeros(0, np.int64)  # number in order of learning
            self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
            return
        keep = self.rank >= first
        self.hashes, self.rank = self.hashes[keep], self.rank[keep] - first
        self.ids = self.ids[self.starts[first] :].copy()
        self.starts = self.starts[first:] - self.starts[first]

    def _size(self) -> int:
        return 24 * len(self.hashes) + 4 * len(self.ids)

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every stretch, and the ids."""
        lengths, found = [], []
        first = 0
        mark = np.frombuffer(MARK, np.uint8)
        total = np.cumsum(end - start + len(mark))
        while first < len(start):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CALL_BYTES, "right")))
            s, n = start[first:last], (end - start)[first:last]
            joined = _gathered(data, s, n)
            if SPECIAL in joined.tobytes():  # a stretch may hold the mark itself, or become it
                parts = [self._encode(data[a : a + m].tobytes()) for a, m in zip(s, n)]
                lengths.append(np.array([len(p) for p in parts], np.int64))
                found += parts
            else:
                text = np.empty(int(n.sum()) + len(mark) * len(n), np.uint8)
                at = np.cumsum(n + len(mark)) - len(mark)
                marks = at[:, None] + np.arange(len(mark))
                inside = np.ones(len(text), bool)
                inside[marks.ravel()] = False
                text[marks], text[inside] = mark, joined
                ids = self._encode(text.tobytes())
                at = np.flatnonzero(ids == self.mark_id)
                lengths.append(np.diff(at, prepend=-1) - 1)
                found.append(ids[ids != self.mark_id])
            first = last
        return np.concatenate(lengths), np.concatenate(found)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids before each text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & ~_UNSAFE[data[1:]]
        if SPECIAL not in data.tobytes():  # a special token is not cut
            cut[1:] |= _WORD[data[:-1]] & _POINT[data[1:]]
            line = _PRINTED[data[:-2]] & (data[1:-1] == 0x0A) & ~_UNSAFE[data[2:]]
            cut[1:-1] |= line
            cut[2:] |= line
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        # a text's first stretch may not begin with a space; it is hashed like any other
        hashes, first, which = np.unique(RangeHash(data).of(start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            if self._size() > self.remembered:
                half = len(self.starts) // 2
                self._forget(half if half > 1 else 0)
                at = np.searchsorted(self.hashes, hashes)
                known = at < len(self.hashes)
                known[known] = self.hashes[at[known]] == hashes[known]
            new = first[~known]
            lengths, ids = self._learn(data, start[new], end[new])
            rank = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(new))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
            self.ids = np.concatenate((self.ids, ids))
            place = np.searchsorted(self.hashes, hashes[~known])
            self.hashes, self.rank = np.insert(self.hashes, place, hashes[~known]), np.insert(self.rank, place, rank)
            at = np.searchsorted(self.hashes, hashes)
        rank = self.rank[at][which]
        lengths = self.starts[rank + 1] - self.starts[rank]
        before = np.concatenate(([0], np.cumsum(lengths)))
        return _gathered(self.ids, self.starts[rank], lengths), before[np.searchsorted(start, offsets)]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One memory of stretches per worker, for the vocabulary that it used last."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = Tokens(path)
    return _tokens[path]
