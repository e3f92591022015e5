"""Normalised words of texts as numbers of a fixed vocabulary, decided on the
words' own bytes (no hashing), in passes of bounded memory.

A word is a maximal run of bytes other than ASCII that is no letter or digit,
with A-Z in lower case: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the
lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

from casepipe.llm.common import LOWER, SLAB, word_bounds

#: Bytes between words.
GAP = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    GAP[_lo:_hi] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHORT = 16


def words_of(text: str | None) -> list[bytes]:
    """The words of one (small) text."""
    return _WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def word_pieces(raw: np.ndarray, at: np.ndarray, size: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(begin, end)`` of the words of the texts that meet at ``at``, some
    ``size`` bytes at a time; a piece ends where a word may not go on."""
    lo, stop = int(at[0]), int(at[-1])
    while lo < stop:
        hi = lo + size
        if hi < stop:
            edge, near = int(at[np.searchsorted(at, hi)]), hi
            while near < edge:
                gaps = GAP[raw[near : min(edge, near + 4096)]]
                if gaps.any():
                    edge = near + int(gaps.argmax())
                near += 4096
            hi = edge
        else:
            hi = stop
        cuts = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi)]
        begin, end = word_bounds(raw[lo:hi], cuts - lo, GAP)
        yield begin + lo, end + lo
        lo = hi


class WordTable:
    """Numbers 0, 1, ... of the distinct words given, in their order."""

    def __init__(self, words: Iterable[bytes]):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        short = [w for w in self.number if len(w) <= _SHORT]
        long = [w for w in self.number if len(w) > _SHORT]
        keys = np.frombuffer(b"".join(w.ljust(_SHORT, b"\0") for w in short), "<u8").reshape(-1, 2)
        self.first, a = np.unique(keys[:, 0], return_inverse=True)
        self.second, b = np.unique(keys[:, 1], return_inverse=True)
        pair = a * max(1, len(self.second)) + b
        order = np.argsort(pair, kind="stable")
        self.pair = pair[order]
        self.of_pair = np.array([self.number[w] for w in short], np.int64)[order] if short else np.zeros(0, np.int64)
        self.long = {w: self.number[w] for w in long}
        self.long_first = np.unique(np.frombuffer(b"".join(w[:8] for w in long), "<u8"))

    def __len__(self) -> int:
        return len(self.number)

    @staticmethod
    def _place(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
        return k, sorted_values[k] == x

    def lookup(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for other words."""
        out = np.full(len(begin), -1, np.int64)
        if not len(begin) or not len(self):
            return out
        lo, hi = int(begin[0]), int(end[-1])
        low = np.zeros(hi - lo + _SHORT, np.uint8)
        low[: hi - lo] = LOWER[raw[lo:hi]]
        size = end - begin
        cells = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(low, _SHORT)[begin - lo])
        cells *= np.arange(_SHORT) < size[:, None]
        key = cells.view("<u8")
        if len(self.pair):
            a, known = self._place(self.first, key[:, 0])
            b, known_b = self._place(self.second, key[:, 1])
            p, known_p = self._place(self.pair, a * len(self.second) + b)
            on = known & known_b & known_p & (size <= _SHORT)
            out[on] = self.of_pair[p[on]]
        if self.long:
            some = self._place(self.long_first, key[:, 0])[1] & (size > _SHORT)
            for i in np.flatnonzero(some).tolist():
                out[i] = self.long.get(low[begin[i] - lo : end[i] - lo].tobytes(), -1)
        return out

    def located(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(numbers, begin, end, first)``: all words of the texts that meet
        at ``at`` in order, their bytes, and each text's offset among them."""
        ids, lo, hi, first = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(at), np.int64)
        for begin, end in word_pieces(raw, at):
            first += np.searchsorted(begin, at)
            ids.append(self.lookup(raw, begin, end).astype(np.int32))
            lo.append(begin)
            hi.append(end)
        return np.concatenate(ids), np.concatenate(lo), np.concatenate(hi), first

    def numbers(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(numbers, first)`` of ``located``."""
        ids, first = [np.zeros(0, np.int32)], np.zeros(len(at), np.int64)
        for begin, end in word_pieces(raw, at):
            first += np.searchsorted(begin, at)
            ids.append(self.lookup(raw, begin, end).astype(np.int32))
        return np.concatenate(ids), first
