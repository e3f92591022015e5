"""Content-defined segments of texts: the exact thinning that both repeat
finders work on.

Of the ``k``-grams in every window of ``length`` symbols the least by hash
(the leftmost of equals) is the window's anchor.  Equal windows have equal
anchors at equal offsets, so windows need only be compared if their anchors'
grams are equal.  Consecutive windows of one text with one anchor make a
segment; two segments with equal extents (and anchor offsets) are equal
window by window, and one row stands for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from casepipe.llm.common import Rolling, mix, sliding_min


class Segments(NamedTuple):
    """Per segment: number of the text, first and last window start (from the
    text's first symbol), hash of the anchor's gram, hash of the extent."""

    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    extent: np.ndarray


def segments(symbols_a: np.ndarray, symbols_b: np.ndarray, at: np.ndarray, length: int, k: int, a: Rolling, b: Rolling) -> Segments:
    """Segments of the texts that ``at`` (offsets) marks in two symbol
    sequences of the same texts; ``a`` and ``b`` are independent hashes."""
    n = len(symbols_a)
    empty = np.zeros(0, np.int64)
    if n < length:
        return Segments(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    gram = a.windows(a.prefix(symbols_a), k)
    bits = np.uint64(n.bit_length())
    packed = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    anchor = (sliding_min(packed, length - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = n - length + 1
    new = np.ones(starts, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    cuts = at[(at > 0) & (at < starts)]
    new[cuts] = True
    # windows across the end of a text: their run begins where the last whole window ends
    late = at[1:] - length + 1
    late = late[(late > 0) & (late < starts)]
    new[late] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], starts) - 1
    text = np.searchsorted(at, lo, "right") - 1
    whole = lo + length <= at[text + 1]
    lo, hi, text = lo[whole], hi[whole], text[whole]
    anchor = anchor[lo]
    pb = b.prefix(symbols_b)
    extent = b.slices(pb, lo, hi + length)
    extent = mix(extent ^ mix((anchor - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)))
    base = at[text]
    return Segments(text, lo - base, hi - base, gram[anchor], extent)


def pieces(n: int, length: int, size: int) -> Iterator[tuple[int, int]]:
    """Overlapping pieces ``[lo, hi)`` of a long text: every window is in one."""
    lo = 0
    while True:
        yield lo, min(n, lo + size + length - 1)
        lo += size
        if lo + length > n:
            break
