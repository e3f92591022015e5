"""Exact de-duplication with a sharded cuckoo-filter index of live digests.

A shard holds a cuckoo filter (buckets of four 16-bit fingerprints) and, slot
by slot beside it, the stored keys: the full digest, the live document and
the number of copies.  A lookup touches the filter first; a fingerprint hit
is verified against the key stored in that slot.  When a copy with a larger
``doc_id`` arrives, the live digest is deleted and the new one inserted.  An
insertion that finds no place in ``MAX_KICKS`` evictions resizes the filter,
which is rebuilt from the stored keys.

Digests go to shards by hash.  Before that, copies of one text are
pre-aggregated per (digest, salt), so a text with a third of all rows reaches
its shard as at most ``SALTS`` rows.  Shard state is rebuilt by rerunning its
task; nothing lives outside the task.

Defined cases: null text counts as empty; a null ``doc_id`` never wins
against another, and is kept only if its group has no other; rows that
repeat a ``doc_id`` and text share one verdict; an empty table gives no row;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import stored, text_or_empty

SLOTS = 4
MAX_KICKS = 200
SALTS = 16
NO_ID = -(1 << 63)


class CuckooIndex:
    """Cuckoo filter over digests with the stored keys beside it.

    ``keys[slot]`` is ``(digest, doc_id, copies)`` or ``None``; ``prints[slot]``
    is the 16-bit fingerprint (0: free).
    """

    def __init__(self, buckets: int = 64):
        self.n = 1 << max(1, (buckets - 1).bit_length())
        self.prints = [0] * (self.n * SLOTS)
        self.keys: list[tuple[bytes, int, int] | None] = [None] * (self.n * SLOTS)
        self.live = 0
        self.resizes = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[:2], "little") % 65535 + 1
        i = int.from_bytes(digest[2:10], "little") & (self.n - 1)
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return i ^ ((fp * 0x5BD1E995) >> 7 & (self.n - 1))

    def find(self, digest: bytes) -> int:
        """Slot of a digest, or -1.  A fingerprint hit counts only if the
        stored key of the slot is the digest itself."""
        fp, a, b = self._places(digest)
        for i in (a,) if a == b else (a, b):
            for slot in range(i * SLOTS, i * SLOTS + SLOTS):
                if self.prints[slot] == fp and self.keys[slot][0] == digest:
                    return slot
        return -1

    def insert(self, digest: bytes, doc_id: int, copies: int) -> None:
        if not self._place((digest, doc_id, copies)):
            self._resize((digest, doc_id, copies))
        self.live += 1

    def _place(self, key: tuple[bytes, int, int]) -> bool:
        fp, a, b = self._places(key[0])
        path = []
        i = a
        for kick in range(MAX_KICKS):
            for j in (a, b) if not kick else (i,):
                for slot in range(j * SLOTS, j * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot] = fp, key
                        return True
            slot = i * SLOTS + kick % SLOTS
            path.append((slot, self.prints[slot], self.keys[slot]))
            (fp, self.prints[slot]), (key, self.keys[slot]) = (self.prints[slot], fp), (self.keys[slot], key)
            i = self._other(i, fp)
        for slot, was, held in reversed(path):  # undo, so that no stored key is lost
            self.prints[slot], self.keys[slot] = was, held
        return False

    def _resize(self, extra: tuple[bytes, int, int]) -> None:
        held = [k for k in self.keys if k is not None] + [extra]
        while True:
            self.n *= 2
            self.resizes += 1
            self.prints = [0] * (self.n * SLOTS)
            self.keys = [None] * (self.n * SLOTS)
            if all(self._place(k) for k in held):
                return

    def delete(self, slot: int) -> tuple[bytes, int, int]:
        key = self.keys[slot]
        self.prints[slot], self.keys[slot] = 0, None
        self.live -= 1
        return key

    def add(self, digest: bytes, doc_id: int, copies: int) -> None:
        """Count copies of a digest; the largest ``doc_id`` stays live."""
        slot = self.find(digest)
        if slot >= 0:
            _, held, n = self.delete(slot)
            doc_id, copies = max(held, doc_id), n + copies
        self.insert(digest, doc_id, copies)

    def rows(self) -> Iterator[tuple[bytes, int, int]]:
        return (k for k in self.keys if k is not None)


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for digest, doc_id, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
            index.add(digest, NO_ID if doc_id is None else doc_id, copies)
    out = list(index.rows())
    for lo in range(0, len(out), 10_000):
        part = out[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in part], pa.binary()),
                pa.array([None if k[1] == NO_ID else k[1] for k in part], pa.int64()),
                pa.array([k[2] for k in part], pa.int64()),
            ],
            names=["digest", "keep_id", "group_size"],
        )


def digest_index(digests: DataFrame) -> DataFrame:
    """``(digest, keep_id, group_size)`` of every distinct digest of
    ``digests(doc_id, digest)``, from one cuckoo index per shuffle partition."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    partial = digests.groupBy("digest", salt.alias("salt")).agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return (
        partial.repartition(F.col("digest"))
        .select("digest", "doc_id", "copies")
        .mapInArrow(_index_shards, "digest binary, keep_id long, group_size long")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)`` of every row of ``docs``."""
    d = docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))
    d = stored(d, "digests")  # 40 bytes a document: the texts are read once
    live = digest_index(d)
    return d.join(live, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
