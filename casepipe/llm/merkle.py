"""Merkle dataset manifest: a SHA midstate tree over all rows.

Each row is a leaf, the SHA-256 of its fields.  Per ``lang`` the leaves, in
order of ``doc_id``, are folded eight at a time until one node is left, and the
languages' nodes likewise.  A child enters its parent as 64 hexadecimal
characters, which is exactly one SHA-256 block, so the hash state before each
child slot is eight words.  Parents retain these states.  To fold a changed
leaf, the state before its slot is resumed with the replacement and the right
siblings only; what stands left of it is never hashed again.  States are plain
numbers, so those of upper levels travel to the tasks that hold the leaves.

The tree is cut into *units* of four levels (4,096 nodes).  A unit's nodes are
folded by one task at once; its top node is a row of the next, 4,096 times
smaller, table.  Going down again, a unit gets its path to the root (states,
left and right siblings per level) as one row and folds all its leaves.

A row's place among its language is the sum of the range sizes before it: the
digests are dealt by ranges of (lang, doc_id, leaf, row key), so a language
with a third of the rows, or rows that repeat an id, spread over all tasks.

Defined cases: nulls of any field read ``-``; rows of null ``lang`` form a
group of their own, first in order; null ids come first; of equal ids the
smaller leaf comes first, and rows equal in all fields are told apart by no
result; a table of one row has its leaf as subroot and root, and an empty proof;
an empty table gives no row; further columns are not hashed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepipe.llm.common import stored

ARITY = 8
LEVELS = 4
UNIT = ARITY**LEVELS
#: Rows that one task folds at once, at least (whole units).
FOLDED = 1 << 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# --- SHA-256 over many states at once ---------------------------------------


def _fractions(n: int, root: int) -> np.ndarray:
    """First 32 bits of the fractional parts of the ``root``-th roots of the first ``n`` primes."""
    primes, k = [], 2
    while len(primes) < n:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1
    out = []
    for p in primes:
        x = p << (32 * root)
        r = math.isqrt(x) if root == 2 else int(round(x ** (1 / 3)))
        while r**root > x:
            r -= 1
        while (r + 1) ** root <= x:
            r += 1
        out.append(r & 0xFFFFFFFF)
    return np.array(out, np.uint32)


START = _fractions(8, 2)
_ROUND = _fractions(64, 3)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States ``(8, n)`` after one more block ``(16, n)`` each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (_ROUND[t] + w[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


_DIGIT = np.frombuffer(b"0123456789abcdef", np.uint8)


def _hex_block(digest: np.ndarray) -> np.ndarray:
    """Digests ``(8, n)`` as blocks ``(16, n)`` of their hexadecimal characters."""
    raw = np.ascontiguousarray(digest.T).astype(">u4").view(np.uint8)
    chars = np.empty((raw.shape[0], 64), np.uint8)
    chars[:, ::2], chars[:, 1::2] = _DIGIT[raw >> 4], _DIGIT[raw & 15]
    return np.ascontiguousarray(chars.view(">u4").astype(np.uint32).T)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of states that have taken ``blocks`` whole blocks each."""
    tail = np.zeros((16, state.shape[1]), np.uint32)
    tail[0] = 0x80000000
    tail[15] = blocks.astype(np.uint32) * np.uint32(512)
    return compress(state, tail)


def _words(digests: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u4").astype(np.uint32).reshape(-1, 8).T


def _bytes(digest: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digest.T).astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


# --- one level ---------------------------------------------------------------


class Level:
    """The parents of nodes in order: each retains the state before every slot."""

    def __init__(self, node: np.ndarray, parent: np.ndarray):
        """``node``: digests ``(8, n)``; ``parent``: the parents' numbers 0, 1, ..., ascending."""
        n = len(parent)
        self.parent = parent
        self.begin = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.begin, n))
        self.slot = np.arange(n) - self.begin[parent] if n else np.zeros(0, np.int64)
        self.block = _hex_block(node)
        #: State before each node's slot.
        self.state = np.empty_like(node)
        now = np.repeat(START[:, None], len(self.begin), axis=1)
        for s in range(int(self.size.max(initial=0))):
            has = np.flatnonzero(self.size > s)
            at = self.begin[has] + s
            self.state[:, at] = now[:, has]
            now[:, has] = compress(now[:, has], self.block[:, at])
        self.digest = finish(now, self.size)

    def fold(self, at: np.ndarray, replacement: np.ndarray) -> np.ndarray:
        """The parents' digests with node ``at`` replaced: the retained state
        takes the replacement and the right siblings."""
        now = compress(self.state[:, at], _hex_block(replacement))
        size = self.size[self.parent[at]]
        for step in range(1, int((size - self.slot[at]).max(initial=1))):
            has = np.flatnonzero(self.slot[at] + step < size)
            now[:, has] = compress(now[:, has], self.block[:, at[has] + step])
        return finish(now, size)

    def siblings(self) -> list[bytes]:
        """Per node the hexadecimal digests of the others of its run, left to right."""
        text = np.ascontiguousarray(self.block.T).astype(">u4").tobytes()
        out = []
        for b, n in zip((self.begin * 64).tolist(), (self.size * 64).tolist(), strict=True):
            run = text[b : b + n]
            out += [run[:i] + run[i + 64 :] for i in range(0, n, 64)]
        return out


def _fold_distinct(level: Level, at: np.ndarray, replacement: np.ndarray) -> np.ndarray:
    """``level.fold``, each distinct (node, replacement) once."""
    key = np.concatenate([at[None].astype(np.uint32), replacement]).T
    _, first, back = np.unique(np.ascontiguousarray(key).view([("", np.uint32)] * 9).ravel(), return_index=True, return_inverse=True)
    return level.fold(at[first], replacement[:, first])[:, back]


class Units:
    """Whole units in order: the levels of each, up to its top node."""

    def __init__(self, unit: np.ndarray, pos: np.ndarray, height: np.ndarray, digest: np.ndarray):
        """Per node its unit's number (0, 1, ..., ascending), its place in the
        tree's lowest level, the number of its unit's levels, and its digest."""
        self.unit, self.height = unit, height
        self.levels: list[Level] = []
        #: Per level the node above each of the unit's rows, before the level.
        self.above: list[np.ndarray] = []
        node, node_unit, place, rest = digest, unit, pos % UNIT, height
        self.at = np.arange(len(unit))
        for _ in range(int(height.max(initial=0))):
            self.above.append(self.at)
            # nodes of lower units stay as they are: their parent is a run of their own that is not hashed
            key = np.stack([node_unit, np.where(rest > 0, place // ARITY, place)])
            parent = np.append(0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0)))
            level = Level(node, parent)
            done = rest[level.begin] <= 0
            level.digest[:, done] = node[:, level.begin[done]]
            level.done = done
            self.levels.append(level)
            node, node_unit, rest = level.digest, node_unit[level.begin], rest[level.begin] - 1
            place = key[1][level.begin]
            self.at = parent[self.at]
        self.top = node  # one node a unit

    def fold(self, replacement: np.ndarray) -> np.ndarray:
        """Each row's top node with the row replaced."""
        now = replacement
        for level, at in zip(self.levels, self.above, strict=True):
            live = np.flatnonzero(~level.done[level.parent[at]])
            if len(live):
                now = now.copy()
                now[:, live] = _fold_distinct(level, at[live], now[:, live])
        return now

    def siblings(self) -> list[bytes]:
        """Per row the siblings' digests of all levels inside the unit."""
        out = [b""] * len(self.unit)
        for level, above in zip(self.levels, self.above, strict=True):
            own = level.siblings()
            out = [x + own[a] for x, a in zip(out, above.tolist(), strict=True)]
        return out


# --- the tree as tables -------------------------------------------------------


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """Hash of a row's fields, each ``-`` if null, else its byte count, ``:``
    and the value; ``changed`` gives other values of some fields."""
    values = [(changed or {}).get(f, F.col(f)).cast("string") for f in FIELDS]
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in their group ``k`` by ``order``, and
    ``n``, the group's size, from ranges of the sorted rows."""
    by = [F.col(c).asc_nulls_first() for c in ("k", *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    ranged = stored(ranged, "merkle-ranges").withColumn("_part", F.shiftright("_m", 33))
    parts = ranged.groupBy("k", "_part").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("k")
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("k", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"))
    return ranged.join(parts, ["k", "_part"]).withColumn("pos", F.col("_m") + F.col("_shift")).drop("_m", "_part", "_shift")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole units from batches sorted by ``k``, ``unit``."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows >= FOLDED:
            edge = np.flatnonzero(_first_of_unit(rest))
            if edge[-1]:
                yield rest.slice(0, int(edge[-1])).combine_chunks()
                rest = rest.slice(int(edge[-1])).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _first_of_unit(t: pa.Table) -> np.ndarray:
    k = t.column("k").combine_chunks().dictionary_encode()
    k = k.indices.to_numpy() if isinstance(k, pa.DictionaryArray) else np.concatenate([c.indices.to_numpy() for c in k.chunks])
    unit = t.column("unit").to_numpy()
    return np.append(True, (k[1:] != k[:-1]) | (unit[1:] != unit[:-1]))


def _height(n: np.ndarray) -> np.ndarray:
    """Levels of a unit in a row of ``n`` nodes."""
    out = np.zeros(len(n), np.int64)
    for i in range(LEVELS):
        out[n > ARITY**i] = i + 1
    return out


def _units(t: pa.Table) -> Units:
    unit = np.cumsum(_first_of_unit(t)) - 1
    return Units(unit, t.column("pos").to_numpy(), _height(t.column("n").to_numpy()), _words(t.column("digest").to_pylist()))


def _up(stage: DataFrame) -> DataFrame:
    """The next stage ``(k, pos, n, digest)``: one node per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches):
            first = np.flatnonzero(_first_of_unit(t))
            n = t.column("n").to_numpy()[first]
            top = pa.array(_bytes(_units(t).top), pa.binary())
            yield pa.RecordBatch.from_arrays([t.column("k").take(pa.array(first)).combine_chunks(), pa.array(t.column("unit").to_numpy()[first]), pa.array(-(-n // UNIT)), top], names=["k", "pos", "n", "digest"])

    d = stage.select("k", F.floor(F.col("pos") / UNIT).alias("unit"), "pos", "n", "digest")
    return d.repartition("k", "unit").sortWithinPartitions("k", "unit", "pos").mapInArrow(run, "k string, pos long, n long, digest binary")


def _tree(rows: DataFrame) -> list[DataFrame]:
    """Stages ``(k, pos, n, digest, ...)`` from the placed rows to one row a group."""
    stages, most = [rows], rows.agg(F.max("n")).first()[0] or 0
    while most > 1:
        stages.append(stored(_up(stages[-1]), "merkle-stage"))
        most = -(-most // UNIT)
    return stages


#: A node's way to the root: per level the state before its slot, how many
#: siblings stand left and right, and these siblings' hexadecimal digests.
PATH = "states binary, shape binary, siblings binary"


class _Paths:
    """The paths above units, to be folded for many nodes at once."""

    def __init__(self, states: list[bytes], shapes: list[bytes], siblings: list[bytes]):
        self.siblings = siblings
        self.depth = np.array([len(s) // 2 for s in shapes], np.int64)
        deepest, n = int(self.depth.max(initial=0)), len(shapes)
        self.state = np.zeros((deepest, 8, n), np.uint32)
        self.right = np.zeros((deepest, n), np.int64)
        self.size = np.ones((deepest, n), np.int64)
        self.block = np.zeros((deepest, ARITY, 16, n), np.uint32)
        for u in range(n):
            own = np.frombuffer(states[u], ">u4").astype(np.uint32).reshape(-1, 8)
            blocks = np.frombuffer(siblings[u], ">u4").astype(np.uint32).reshape(-1, 16)
            at = 0
            for i in range(int(self.depth[u])):
                left, right = shapes[u][2 * i], shapes[u][2 * i + 1]
                self.state[i, :, u], self.right[i, u], self.size[i, u] = own[i], right, left + 1 + right
                self.block[i, :right, :, u] = blocks[at + left : at + left + right]
                at += left + right

    def fold(self, unit: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Roots that the units' nodes lead to; each distinct (unit, node) is folded once."""
        key = np.ascontiguousarray(np.concatenate([unit[None].astype(np.uint32), node]).T).view([("", np.uint32)] * 9).ravel()
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        unit, now = unit[first], node[:, first].copy()
        for i in range(len(self.state)):
            live = np.flatnonzero(self.depth[unit] > i)
            u = unit[live]
            step = compress(self.state[i][:, u], _hex_block(now[:, live]))
            for r in range(int(self.right[i, u].max(initial=0))):
                has = np.flatnonzero(self.right[i, u] > r)
                step[:, has] = compress(step[:, has], self.block[i, r][:, u[has]])
            now[:, live] = finish(step, self.size[i, u])
        return now[:, back]


def _with_paths(stage: DataFrame, paths: DataFrame, extra: list[str]) -> DataFrame:
    """The nodes of a stage, each unit's led by a row with its path (``pos`` -1)."""
    d = stage.select("k", F.floor(F.col("pos") / UNIT).alias("unit"), "pos", "n", "digest", *extra)
    lead = paths.select("k", F.col("pos").alias("unit"), F.lit(-1).cast("long").alias("pos"), "states", "shape", "siblings", "subroot")
    return d.unionByName(lead, allowMissingColumns=True).repartition("k", "unit").sortWithinPartitions("k", "unit", "pos")


def _split(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The leading rows with paths and the nodes."""
    lead = t.column("pos").to_numpy() < 0
    return t.filter(pa.array(lead)), t.filter(pa.array(~lead))


def _down(stage: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths ``(k, pos, subroot, states, shape, siblings)`` of a stage's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches):
            lead, t = _split(t)
            u = _units(t)
            states, shapes = [b""] * t.num_rows, [b""] * t.num_rows
            for level, above in zip(u.levels, u.above, strict=True):
                live = ~level.done[level.parent[above]]
                slot, size = level.slot[above], level.size[level.parent[above]]
                for i, s in zip(np.flatnonzero(live).tolist(), _bytes(level.state[:, above[live]]), strict=True):
                    states[i] += s
                    shapes[i] += bytes((int(slot[i]), int(size[i] - slot[i] - 1)))
            upper = [lead.column(c).to_pylist() for c in ("states", "shape", "siblings")]
            own = zip(states, shapes, u.siblings(), u.unit.tolist(), strict=True)
            rows = [(s + upper[0][g], h + upper[1][g], x + upper[2][g]) for s, h, x, g in own]
            subroot = lead.column("subroot").take(pa.array(u.unit)).combine_chunks()
            cols = [pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks(), t.column("pos").combine_chunks(), subroot, *cols], names=["k", "pos", "subroot", "states", "shape", "siblings"])

    return _with_paths(stage, paths, []).mapInArrow(run, f"k string, pos long, subroot binary, {PATH}")


class Manifest:
    """The tree over a table: ``leaves`` and the stages above them as stored
    tables, the tree over the languages' subroots, and the ``root``."""

    def __init__(self, docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None):
        """``changed``: other values of fields, taken for the rows ``where``,
        whose leaves ``proofs`` folds in place of the original ones."""
        group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then by bytes
        other = F.when(where, leaf(changed)) if changed else F.lit(None).cast("binary")
        rows = docs.select(group.alias("k"), "doc_id", leaf().alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("_row"))
        self.leaves = stored(_placed(stored(rows, "merkle-leaves"), ["doc_id", "digest", "_row"]).drop("_row"), "merkle-placed")
        self.stages = _tree(self.leaves)
        self.subroots = self.stages[-1].select("k", "digest")
        groups = self.subroots.select(F.lit("").alias("k"), F.col("k").alias("group"), "digest")
        self.top = _tree(stored(_placed(groups, ["group"]), "merkle-groups"))
        top = self.top[-1].select("digest").first()
        #: The root's digest, null of an empty table.
        self.root: bytes | None = bytes(top[0]) if top else None

    def proofs(self) -> DataFrame:
        """``(doc_id, leaf, subroot, proof_sha256, folded_root)`` of each row,
        digests in binary: its leaf (or the changed one) folded to the root."""
        empty = F.lit(b"")
        paths = self.top[-1].select("k", "pos", F.lit(None).cast("binary").alias("subroot"), empty.alias("states"), empty.alias("shape"), empty.alias("siblings"))
        for stage in reversed(self.top[:-1]):
            paths = stored(_down(stage, paths), "merkle-paths")
        # the top tree's rows are the languages' last nodes
        group = self.top[0].select("pos", F.col("group").alias("_k"), F.col("digest").alias("_d"))
        paths = paths.join(group, "pos").select(F.col("_k").alias("k"), F.lit(0).cast("long").alias("pos"), F.col("_d").alias("subroot"), "states", "shape", "siblings")
        for stage in reversed(self.stages[1:-1]):
            paths = stored(_down(stage, paths), "merkle-paths")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole_units(batches):
                lead, t = _split(t)
                u = _units(t)
                own, other = t.column("digest").to_pylist(), t.column("changed").to_pylist()
                above = _Paths(*(lead.column(c).to_pylist() for c in ("states", "shape", "siblings")))
                folded = above.fold(u.unit, u.fold(_words([c or d for c, d in zip(other, own, strict=True)])))
                proof = [hashlib.sha256(x + above.siblings[g]).digest() for x, g in zip(u.siblings(), u.unit.tolist(), strict=True)]
                subroot = lead.column("subroot").take(pa.array(u.unit)).combine_chunks()
                cols = [t.column("doc_id").combine_chunks(), t.column("digest").combine_chunks(), subroot, pa.array(proof, pa.binary()), pa.array(_bytes(folded), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

        kind = dict(self.leaves.dtypes)["doc_id"]
        rows = _with_paths(self.leaves, paths, ["doc_id", "changed"])
        return rows.mapInArrow(run, f"doc_id {kind}, leaf binary, subroot binary, proof_sha256 binary, folded_root binary")


def tampered() -> tuple[dict[str, Column], Column]:
    """The tampering of the contract: texts in lower case (A-Z alone) where 3 divides ``crc32(doc_id)``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"text": F.translate("text", upper, upper.lower())}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0
