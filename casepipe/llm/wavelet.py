"""Token-id shards as wavelet matrices.

``write_shards`` encodes whole texts, appends an end id to each document and
writes the ids in ascending ``doc_id`` order.  Documents are dealt by ranges
of ``doc_id``; each task cuts its range into shards of about
``SHARD_TOKENS`` ids and emits one row per shard, which Spark's own Parquet
writer commits: compressed files of bit-planes that any store can hold, and that a
lost executor's task writes again.

A shard row holds, for each bit of the ids from the highest, the plane of
bits in wavelet order and a directory of ones before every 512 bits.
``WaveletMatrix`` answers access, rank, select and occurrence lookups from
them, and ``ids()`` restores the whole sequence.

Defined cases: null text counts as empty (its document is the end id alone);
a null ``doc_id`` comes first; rows with equal ``doc_id`` are documents of
their own in any order; a text longer than a shard gets a shard of its own;
an empty table writes no shard; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casepipe.llm.common import flat, hash_words, slabs, text_or_empty, word_bounds
from casepipe.llm.tokencount import LETTERS, NUMBERS, UNCHECKED, byte_characters

SHARD_TOKENS = 1 << 21
#: Text that is encoded at once.
BATCH_BYTES = 1 << 22
CACHE_ENTRIES = 2_000_000
BLOCK_BITS = 512
SHARD_SCHEMA = (
    "shard long, n_tokens long, n_planes int, zeros array<long>, planes binary, ranks binary, doc_ids array<long>, doc_ends array<long>"
)
#: The pre-token pattern of the lower-cased word vocabulary, on the checked range.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


#: Bytes that send a text to a closer look: control characters that some take
#: for white space, the first character of special tokens, and first bytes of
#: characters that may lie beyond the checked range.
CLOSE = np.zeros(256, bool)
CLOSE[[0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0x7F, 0xC2, 0xC4, *range(0xC6, 0x100)]] = True
#: Characters of the checked range whose lower case has more bytes.
_grows = re.compile("[\\u0130\\u023a\\u023e]")


class WaveletMatrix:
    """Succinct sequence of ``n`` ids below ``2 ** n_planes``.

    ``bits`` is one row of packed bytes per plane (least significant bit
    first), ``ranks`` the ones before each block of ``BLOCK_BITS``, ``zeros``
    the zeros in each plane.
    """

    def __init__(self, n: int, zeros: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.n, self.zeros, self.bits, self.ranks = n, zeros, bits, ranks
        self.n_planes = len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray, n_planes: int) -> WaveletMatrix:
        n = len(ids)
        blocks = -(-n // BLOCK_BITS) or 1
        width = blocks * BLOCK_BITS // 8
        bits = np.zeros((n_planes, width), np.uint8)
        zeros = np.zeros(n_planes, np.int64)
        seq = ids
        for p in range(n_planes):
            one = seq & seq.dtype.type(1 << (n_planes - 1 - p)) != 0
            packed = np.packbits(one, bitorder="little")
            bits[p, : len(packed)] = packed
            low = np.compress(~one, seq)
            zeros[p] = len(low)
            seq = np.concatenate([low, np.compress(one, seq)])
        ones = np.bitwise_count(bits.reshape(n_planes, blocks, -1)).sum(axis=2, dtype=np.uint32)
        ranks = np.zeros((n_planes, blocks + 1), np.uint32)
        np.cumsum(ones, axis=1, out=ranks[:, 1:])
        return cls(n, zeros, bits, ranks)

    @classmethod
    def of_row(cls, row: dict) -> WaveletMatrix:
        """From a row of the file format."""
        p = row["n_planes"]
        return cls(
            row["n_tokens"],
            np.asarray(row["zeros"], np.int64),
            np.frombuffer(row["planes"], np.uint8).reshape(p, -1),
            np.frombuffer(row["ranks"], np.uint32).reshape(p, -1),
        )

    def bit(self, p: int, i: int) -> int:
        return int(self.bits[p, i >> 3]) >> (i & 7) & 1

    def ones(self, p: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block = i // BLOCK_BITS
        lo = block * BLOCK_BITS // 8
        out = int(self.ranks[p, block]) + int(np.bitwise_count(self.bits[p, lo : i >> 3]).sum())
        return out + (int(self.bits[p, i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else out

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        out = 0
        for p in range(self.n_planes):
            b, r = self.bit(p, i), self.ones(p, i)
            out = out << 1 | b
            i = int(self.zeros[p]) + r if b else i - r
        return out

    def _span(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the positions before ``i`` that hold ``symbol`` end up after the last plane."""
        lo, hi = 0, i
        for p in range(self.n_planes):
            a, b = self.ones(p, lo), self.ones(p, hi)
            if symbol >> (self.n_planes - 1 - p) & 1:
                lo, hi = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` occurs before position ``i``."""
        lo, hi = self._span(symbol, i)
        return hi - lo

    def _find(self, p: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit`` of a plane."""
        starts = np.arange(self.ranks.shape[1], dtype=np.int64) * BLOCK_BITS
        before = self.ranks[p].astype(np.int64)
        before = before if bit else starts - before
        block = int(np.searchsorted(before, k, "right")) - 1
        lo = block * BLOCK_BITS // 8
        own = np.unpackbits(self.bits[p, lo : lo + BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(own == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``symbol``; -1 if there are fewer."""
        lo, hi = self._span(symbol, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for p in reversed(range(self.n_planes)):
            b = symbol >> (self.n_planes - 1 - p) & 1
            i = self._find(p, b, i - int(self.zeros[p]) if b else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.rank(symbol, self.n))]

    def ids(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest bit."""
        out = np.zeros(self.n, np.uint16 if self.n_planes <= 16 else np.uint32)
        for p in reversed(range(self.n_planes)):
            one = np.unpackbits(self.bits[p], count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[p])
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[:z]
            above[np.flatnonzero(one)] = out[z:] | out.dtype.type(1 << (self.n_planes - 1 - p))
            out = above
        return out


class WordIds:
    """Encoder of a lower-cased word vocabulary.

    The ids of known words lie in one array; sorted 64-bit hashes of the words
    tell where.  The distinct words of a batch are looked up by one sorted
    search, and their ids are gathered by index, so no Python object is made
    for a word that is known.  Misses run the library's merges.
    """

    def __init__(self, tokenizer, kind: type = np.uint16, limit: int = CACHE_ENTRIES):
        self.tokenizer, self.merge, self.kind, self.limit = tokenizer, tokenizer.model.tokenize, kind, limit
        self.shown = byte_characters()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _merged(self, word: str) -> list[int]:
        shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        return [t.id for t in self.merge(shown)]

    def _word(self, part: str) -> list[int]:
        """Ids of a text part without white space."""
        if part.isalpha():
            return self._merged(part)
        return [i for w in WORD.findall(part) for i in self._merged(w)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        if len(self.known) + len(hashes) > max(self.limit, len(hashes)):
            self._forget()
        new = [self._word(w.decode()) for w in words]
        size = np.array([len(x) for x in new], np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for x in new for i in x], self.kind)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = (np.insert(old, at, x) for old, x in ((self.known, hashes), (self.start, start), (self.size, size)))

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each (sorted) hash among the known ones, and whether it is known."""
        at = np.searchsorted(self.known, hashes)
        return at, (self.known[np.minimum(at, len(self.known) - 1)] == hashes) & (at < len(self.known)) if len(self.known) else np.zeros(len(at), bool)

    def encode(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_many(raw, np.array([0, len(raw)]))[0]

    def _by_library(self, raw: bytes) -> bytes:
        return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def encode_many(self, raw: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of each of the texts at ``at`` in ``raw``.  Words are told apart
        by hash, so every distinct word of the batch is looked up once.  Texts
        beyond the checked range go to the library as a whole."""
        close = np.unique(np.searchsorted(at, np.flatnonzero(CLOSE[raw]), "right") - 1)
        whole = [i for i in close.tolist() if UNCHECKED.search(t := raw[at[i] : at[i + 1]].tobytes().decode()) or _grows.search(t)]
        if whole:
            own = np.repeat(np.isin(np.arange(len(at) - 1), whole), np.diff(at))
            plain = np.where(own, np.uint8(0x20), raw).tobytes()
        else:
            plain = raw.tobytes()
        joined = plain.decode().lower().encode()  # lower case has the same number of bytes here
        raw_low = np.frombuffer(joined, np.uint8)
        lo, hi = word_bounds(raw_low, at)
        h = hash_words(raw_low, lo, hi, 7)
        distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
        at_known, known = self._found(distinct)
        if not known.all():
            miss = np.flatnonzero(~known)
            self._learn(distinct[miss], [joined[x:y] for x, y in zip(lo[first[miss]].tolist(), hi[first[miss]].tolist(), strict=True)])
            at_known, known = self._found(distinct)
            if not known.all():  # the cache was started anew
                self._forget()
                self._learn(distinct, [joined[x:y] for x, y in zip(lo[first].tolist(), hi[first].tolist(), strict=True)])
                at_known, _ = self._found(distinct)
        n = self.size[at_known].astype(np.int32)[word]
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        shift = (self.start[at_known][word] - ends[:-1]).astype(np.int64)
        ids = self.ids[np.repeat(shift, n) + np.arange(ends[-1])].tobytes()
        cut = (ends[np.searchsorted(lo, at)] * np.dtype(self.kind).itemsize).tolist()
        out = [ids[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        for i in whole:
            out[i] = self._by_library(raw[at[i] : at[i + 1]].tobytes())
        return out


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, n_planes: int = 16) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizers file ``vocabulary``
    (readable by every executor) and write the shards to ``path``.

    Shard numbers ascend with ``doc_id``: the task's number in the upper bits.
    """
    kind = np.uint16 if n_planes <= 16 else np.uint32
    item = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.no_truncation()
        t.no_padding()
        words, end = WordIds(t, kind), np.array([end_id], kind).tobytes()
        shard = TaskContext.get().partitionId() << 32
        ids: list[bytes] = []
        names: list[int | None] = []
        ends: list[int] = []
        total = 0

        def full() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.frombuffer(b"".join(ids), kind), n_planes)
            row = [[shard], [m.n], [n_planes], [m.zeros.tolist()], [m.bits.tobytes()], [m.ranks.tobytes()], [names], [ends]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=cols)

        for b in batches:
            raw, at = flat(b.column(1))
            doc_ids = b.column(0).to_pylist()
            for lo, hi in slabs(at, BATCH_BYTES):
                for doc_id, own in zip(doc_ids[lo:hi], words.encode_many(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), strict=True):
                    ids.append(own + end)
                    total += len(own) // item + 1
                    names.append(doc_id)
                    ends.append(total)
                    if total >= SHARD_TOKENS:
                        yield full()
                        shard, ids, names, ends, total = shard + 1, [], [], [], 0
        if ids:
            yield full()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id")
        .mapInArrow(run, SHARD_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
            ids = WaveletMatrix.of_row(row).ids().astype("<u4")
            ends = np.asarray(row["doc_ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(ends), pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(ids[a:z]) for a, z in zip(starts, ends, strict=True)], pa.int64()),
                ],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the
    shard files.  The window that adds up shard sizes has one row per shard."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("shard", F.col("n_tokens").alias("size")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    own = shards.mapInArrow(_read, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return own.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
