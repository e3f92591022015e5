"""Helpers shared by the operators: table access, shared scratch folders,
Arrow text columns as numpy bytes, rolling hashes and sliding minima."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casepipe.session import ensure_checkpoint_dir

#: Bytes of text that one numpy pass works on; longer texts are cut into
#: overlapping pieces of this size, so memory does not follow a text's length.
SLAB = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the
    lineage is cut, a lost executor costs nothing, and each reader prunes
    columns.  The write's shuffle files go when it is done."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Remove folders that ``stored`` wrote and nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slabs(at: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges ``[lo, hi)`` of about ``size`` bytes, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Polynomial hash modulo 2**64 over a sequence of 64-bit symbols, with an
    odd base: prefix sums give the hash of any slice by one subtraction and
    one multiplication with an inverse power.  Only for slices of some hundred
    symbols: from 512 on there are sequences that collide whatever the base
    (words, which may be of any length, have ``hash_words``)."""

    def __init__(self, seed: int):
        self.seed = seed
        self.base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1) + 0x1D8E4E27C47D124F) % (1 << 64) | 5)
        self.symbol = mix(np.arange(1, 257, dtype=np.uint64) * self.base)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            m = 1 << (n - 1).bit_length()
            inv = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.power = np.concatenate([np.ones(1, np.uint64), np.full(m - 1, self.base)]).cumprod(dtype=np.uint64)
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.full(m - 1, inv)]).cumprod(dtype=np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._reach(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.power[: len(symbols)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.inverse[lo])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of each slice of ``k`` symbols."""
        n = max(0, len(prefix) - k)
        return mix((prefix[k:] - prefix[:n]) * self.inverse[:n]) if n else np.zeros(0, np.uint64)


#: Places of a word that have random values of their own in the table of ``hash_words``.
PLACES = 64


@cache
def _place_values(seed: int) -> np.ndarray:
    return mix(mix(np.arange(PLACES * 256, dtype=np.uint64) + np.uint64((2 * seed + 1) << 32)) + np.uint64(seed))


def hash_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of words at ``begin`` to ``end`` in ``raw``: the sum of a
    random value for every (place, byte), with the length mixed in.  No power
    of a base is involved, so no two words collide for every seed."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    place = np.zeros(len(raw), np.int64)
    place[begin] = begin
    np.subtract(np.arange(len(raw)), np.maximum.accumulate(place, out=place), out=place)
    value = _place_values(seed)[np.minimum(place, PLACES - 1) << 8 | raw]
    far = np.flatnonzero(place >= PLACES - 1)
    value[far] = mix(value[far] ^ (place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=prefix[1:])
    return mix(prefix[end] - prefix[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values (block prefix / suffix minima)."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


#: Separators of the word contracts: blank and the control characters 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case of A-Z alone, by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in ``raw``; ``at`` are offsets where texts
    meet, at which words end too."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = at[(at > 0) & (at < n)]
    begin[cuts] = inside[cuts]
    stop = np.zeros(n + 1, bool)
    stop[1:n] = inside[:-1] & ~inside[1:]
    stop[n] = inside[-1]
    stop[cuts] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop)


def safe_parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each cut before a blank
    between two characters that are no white space: no pre-token spans it."""
    lo, n = 0, len(text)
    while n - lo > 2 * size:
        cut = text.find(" ", lo + size)
        while 0 < cut < n - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut <= 0 or cut >= n - 1:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]
