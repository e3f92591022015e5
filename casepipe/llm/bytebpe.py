"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries come from arrays, not from a regular expression: every
code point gets a class (letter, number, white space, other) from a table;
looking one or two positions ahead turns classes into symbols; and a small
automaton over the symbols marks where pre-tokens begin.  The automaton's
transition functions compose associatively, so they are scanned in two
levels: all blocks of a text run in step through every start state, block
functions are composed in order, and a second pass marks the boundaries.

The resulting byte slices go to a cache of pair merges by rank.  ``encode``
keeps the byte offset of every token, and ``decode`` maps ids to bytes.

Defined cases: null text counts as empty (no ids); rows with equal ids are
encoded each; very long texts are cut where a pre-token begins; an empty
table gives no row; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import safe_parts, text_or_empty

#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Symbols of the automaton: blank or other white space at the end of its run
#: before a character, white space elsewhere, apostrophes that a one- or
#: two-letter ending follows, and the limit between two texts.
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_BLANK_LAST, S_WHITE_LAST, S_TICK1, S_TICK2, S_LIMIT = range(9)
#: States: a pre-token begins next; inside letters, numbers, others, white
#: space; a blank waits for its run; one or two letters of an ending are left.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, BLANK, END1, END2 = range(8)
BLOCK = 64
CACHE_ENTRIES = 700_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, begins a pre-token)`` by symbol and state."""
    go = {S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_OTHER: IN_OTHER, S_WHITE: IN_WHITE, S_BLANK_LAST: BLANK, S_WHITE_LAST: FRESH, S_TICK1: END1, S_TICK2: END2, S_LIMIT: FRESH}
    step = np.zeros((9, 8), np.uint8)
    cut = np.ones((9, 8), bool)
    for symbol, state in go.items():
        step[symbol, :] = state
    stay = {(S_LETTER, IN_LETTER): IN_LETTER, (S_NUMBER, IN_NUMBER): IN_NUMBER, (S_WHITE, IN_WHITE): IN_WHITE}
    stay |= {(S_LETTER, BLANK): IN_LETTER, (S_NUMBER, BLANK): IN_NUMBER}
    stay |= {(x, s): IN_OTHER for x in (S_OTHER, S_TICK1, S_TICK2) for s in (IN_OTHER, BLANK)}
    stay |= {(S_LETTER, END1): FRESH, (S_LETTER, END2): END1}
    for (symbol, state), to in stay.items():
        step[symbol, state], cut[symbol, state] = to, False
    return step, cut


STEP, CUT = _automaton()


def character_classes(pattern: str | None = None) -> np.ndarray:
    """Class of every code point.  Code points that Python's Unicode tables
    don't assign are asked of the library's own pattern engine, whose tables may be newer."""
    out = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        elif kind == "Cn" and c < 0x40000:
            unknown.append(c)
    out[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    if pattern:
        import tiktoken

        for kind, probe in ((LETTER, "a"), (NUMBER, "1")):
            # one id for the probe and a following byte: it arises if both stand in one pre-token
            ranks = {bytes([i]): i for i in range(256)} | {probe.encode() + bytes([i]): 256 + i for i in range(256)}
            e = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            out[[c for c in unknown if e.encode_ordinary(probe + chr(c))[0] >= 256]] = kind
    return out


def symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of every code point; code point 0x110000 is the limit between texts."""
    n = len(points)
    limit = points == 0x110000
    kind = classes[np.where(limit, 0x20, points)]
    out = np.array([S_WHITE, S_LETTER, S_NUMBER, S_OTHER], np.uint8)[kind]
    out[limit] = S_LIMIT
    if n > 1:
        at = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~limit[:-1])
        out[at] = np.where(points[at] == 0x20, S_BLANK_LAST, S_WHITE_LAST)
        tick = np.flatnonzero(points[:-1] == 0x27)
        if len(tick):
            a = points[tick + 1]
            b = points[np.minimum(tick + 2, n - 1)] * (tick + 2 < n)
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
            out[tick[one]] = S_TICK1
            out[tick[two]] = S_TICK2
    return out


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """True where a pre-token begins, by the two-level scan."""
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, S_LIMIT, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # step j of all blocks is one row
    step = STEP.ravel()
    # transition function of each block: its end state from every start state
    ends = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(BLOCK):
        ends = step[(grid[j].astype(np.uint8) * np.uint8(8))[:, None] + ends]
    state = np.zeros(rows, np.uint8)
    now = FRESH
    for r, row in enumerate(ends.tolist()):
        state[r] = now
        now = row[now]
    out = np.zeros((BLOCK, rows), bool)
    cut = CUT.ravel()
    for j in range(BLOCK):
        k = grid[j] * np.uint8(8) + state
        out[j] = cut[k]
        state = step[k]
    return out.T.ravel()[:n]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == 1 << 60:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


class Merges(dict):
    """Ids, as little-endian 32-bit bytes, by pre-token.  A miss is merged by
    the library's pair merging of one slice where that is installed
    (``merge_pairs`` is the same rule in Python, ten times slower)."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.limit = limit
        try:
            import tiktoken

            self.merge = tiktoken.Encoding("slices", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        except ImportError:
            self.merge = lambda piece: merge_pairs(piece, ranks)

    def __missing__(self, piece: bytes) -> bytes:
        out = np.array(self.merge(piece), "<u4").tobytes() if piece else b""
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out


class ByteBpe:
    """Encoder and decoder over the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.merges, self.classes = Merges(ranks), classes
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.width = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes; the texts are scanned as one array."""
        points = np.concatenate([p for t in texts for p in (np.frombuffer(t.encode("utf-32-le"), np.uint32), LIMIT)]) if texts else LIMIT[:0]
        limit = points == 0x110000
        begin = np.flatnonzero(boundaries(symbols(points, self.classes)))
        width = np.ones(len(points), np.int64)
        if points.max(initial=0) > 0x7F:
            width += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width[limit] = 0
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        raw = "".join(texts).encode()
        place = at[begin].tolist()
        place.append(len(raw))
        pieces = [raw[a:b] for a, b in zip(place, place[1:], strict=False)]
        # limits are pre-tokens of no bytes: they end the ids of their text
        ends = np.flatnonzero(limit[begin]).tolist()
        out, lo, get = [], 0, self.merges.__getitem__
        for e in ends:
            out.append(b"".join(map(get, pieces[lo:e])))
            lo = e + 1
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_many(list(safe_parts(text))))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset in the text at which each token begins."""
        w = self.width[np.frombuffer(ids, "<u4")]
        return np.cumsum(w) - w

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


LIMIT = np.array([0x110000], np.uint32)
#: Characters of short texts that are scanned at once.
SCAN = 1 << 18


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, keep_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of whole texts by the
    ranks at ``path`` (readable by every executor); with ``keep_ids`` also
    ``ids`` and ``offsets`` (binary, little-endian 32 and 64 bits).  ``keep``
    names columns of ``docs`` that are carried along.

    The class table that is broadcast has one byte per code point.
    """
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(character_classes(pattern).tobytes())
    kept = keep or []
    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *kept).schema
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("ids", "binary").add("offsets", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(load_ranks(path), np.frombuffer(classes.value, np.uint8))
        for b in batches:
            column, lo = b.column(0), 0
            while lo < b.num_rows:
                texts, size, hi = [], 0, lo
                while hi < b.num_rows and (hi == lo or size < SCAN):
                    texts.append(column[hi].as_py())
                    size += len(texts[-1])
                    hi += 1
                ids = bpe.encode_many(texts) if size <= 4 * SCAN else [bpe.encode(t) for t in texts]
                cols = [
                    *(b.column(i).slice(lo, hi - lo) for i in range(1, b.num_columns)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if keep_ids:
                    cols += [pa.array(ids, pa.binary()), pa.array([bpe.offsets(x).astype("<i8").tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                lo = hi

    return docs.select(text_or_empty().alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), *kept).mapInArrow(run, schema)
