"""MinHash near-de-duplication with an LSH forest.

Every document's set of word shingles gets a MinHash signature.  The forest
is ``TREES`` sorted orders of signature slices: documents next to each other
in an order share the longest prefixes, and are candidates if they share at
least ``DEPTH`` values.  The depth adapts to the region: every row is compared
with the row right before it and with the first row of its group.  In a region
of few rows the group is all that share the first ``DEPTH`` values; a crowded
region is cut finer, to the rows that share as many values, up to ``DEEPEST``,
as the row does with its neighbour.  Each row has two candidates an order at most.

Documents with equal sets are one node beforehand.  The orders are dealt by
ranges of the whole sort key, document included, so a prefix that a third of
all rows share spreads over many tasks; the last row of one range and the
first of the next are candidates too.

Candidates are confirmed on the full sets, the most frequent ones first:
links join components, and pairs inside one component need no confirmation
any more.  Every candidate pair across components is confirmed.  The forest is
then walked once more with the components known: each row is compared with
those of the ``NEXT`` rows before it in its region that belong to other
components, and pairs whose signatures agree in three fifths of their values are
confirmed.  So rows at the rim of a crowded family, which few of its members
are similar to, are met many times, and rows that are joined already cost nothing.

Rows of a region longer than that walk, or cut by the border of a range, that
holds more than one component, are then joined exactly (``prefix_pairs``): two sets that are similar enough share
one of the rarest shingles of each, and every pair of different components that
does is confirmed, however many rows the region has.

Defined cases: null text and texts without words have empty sets and are
linked with nothing; a text of fewer words than a shingle is one shingle;
``doc_id`` names a document: rows that repeat one share its links; null ids
are one name, smaller than all others; an empty table gives no row; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casepipe.llm.common import LOWER, Rolling, drop_stored, flat, slabs, stored
from casepipe.llm.graph import components
from casepipe.llm.repeats import NO_DOC, named_texts, word_hashes

SHINGLE = 5
#: Least share of the intersection in the union, in hundredths.
SIMILARITY = 75
TREES = 32
DEPTH = 4
DEEPEST = 8
VALUES = TREES * DEPTH
#: Rows of a region that are compared with its first row.
FEW = 16
#: Rows before a row that it is compared with in the second walk.
NEXT = 20
#: Signature values, by their lowest byte, that travel with a row there, and how
#: many must agree: pairs at the least similarity fail with probability 1e-5.
SKETCH = VALUES
AGREE = 75


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: Rolling, shingles: Rolling) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    (h,), off = word_hashes(LOWER[raw], at, (words,))
    prefix = shingles.prefix(h)
    n = np.diff(off)
    start = np.arange(max(0, len(h) - SHINGLE + 1))
    all_ = shingles.slices(prefix, start, start + SHINGLE)
    out = []
    for lo, m in zip(off[:-1].tolist(), n.tolist(), strict=True):
        if m >= SHINGLE:
            out.append(np.unique(all_[lo : lo + m - SHINGLE + 1]))
        elif m:
            out.append(shingles.slices(prefix, np.array([lo]), np.array([lo + m])) ^ np.uint64(m))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc, n_shingles, digest, signature)``; ``digest`` names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shingles = Rolling(4), Rolling(5)
        mul, add = _permutations()
        for b in batches:
            raw, at = flat(b.column(1))
            for lo, hi in slabs(at):
                sets = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words, shingles)
                size = np.array([len(s) for s in sets], np.int64)
                values = np.zeros((hi - lo, VALUES), np.uint32)
                full = np.flatnonzero(size)
                if len(full):
                    joined = np.concatenate(sets)
                    first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    for j in range(VALUES):
                        values[full, j] = np.minimum.reduceat(joined * mul[j] + add[j], first) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(size),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([v.tobytes() for v in values], pa.binary()),
                    ],
                    names=["doc", "n_shingles", "digest", "signature"],
                )

    return named_texts(docs).mapInArrow(run, "doc long, n_shingles long, digest binary, signature binary")


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(tree, prefix, deeper, doc)``: the hash of a tree's first ``DEPTH``
    values and the next ones, 16 bits each, from the highest bits down."""
    h = Rolling(6)
    for b in batches:
        raw, at = flat(b.column(1))
        sig = raw[at[0] : at[-1]].view(np.uint32).reshape(-1, VALUES)
        n = len(sig)
        wide = np.concatenate([sig, sig[:, :DEEPEST]], axis=1).astype(np.uint64)
        prefix, deeper = np.zeros((TREES, n), np.uint64), np.zeros((TREES, n), np.uint64)
        for t in range(TREES):
            at_t = wide[:, t * DEPTH : t * DEPTH + DEEPEST]
            prefix[t] = (at_t[:, :DEPTH] * (h.base ** np.arange(1, DEPTH + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
            for j in range(DEPTH, DEEPEST):
                deeper[t] = deeper[t] << np.uint64(16) | (at_t[:, j] & np.uint64(0xFFFF))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(TREES, dtype=np.int8), n)),
                pa.array(prefix.ravel().view(np.int64)),
                pa.array(deeper.ravel().view(np.int64)),
                pa.array(np.tile(b.column(0).to_numpy(), TREES)),
            ],
            names=["tree", "prefix", "deeper", "doc"],
        )


def _shared_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many 16-bit values two words have in common from the highest on."""
    d = (x ^ y).view(np.uint64)
    n = np.full(len(d), DEEPEST - DEPTH)
    for j in range(DEEPEST - DEPTH):
        n[d >> np.uint64(16 * j) != 0] = DEEPEST - DEPTH - 1 - j
    return n


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs ``a < b`` of a sorted range; rows with ``edge`` 1 and 2
    are the range's first and last row, ``a`` the document."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["edge", "part", "tree", "prefix", "a", "b"]
    rest: pa.Table | None = None
    last = None

    def rows(edge: int, tree, prefix, a, b) -> pa.RecordBatch:
        n = len(a)
        cols = [np.full(n, edge, np.int8), np.full(n, part, np.int32), tree, prefix, a, b]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    heads = np.full(DEEPEST - DEPTH + 1, -1, np.int64)  # documents that lead the groups of the row before, by depth
    place = 0  # of the row before in its region
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        carried = 0 if rest is None else rest.num_rows
        t = t if rest is None else pa.concat_tables([rest, t])
        tree, prefix, deeper, doc = (t.column(n).to_numpy() for n in ("tree", "prefix", "deeper", "doc"))
        if rest is None:
            yield rows(1, tree[:1], prefix[:1], doc[:1], doc[:1])
        same = np.zeros(len(doc), bool)
        same[1:] = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1])
        depth = np.full(len(doc), -1)
        depth[1:] = np.where(same[1:], _shared_values(deeper[1:], deeper[:-1]), -1)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        index = np.arange(len(doc))
        i = index[carried:][same[carried:]]
        pairs.append((doc[i - 1], doc[i]))
        opens = np.maximum.accumulate(np.where(~same & (index >= carried), index, -1))
        rank = np.where(opens >= 0, index - opens, place + 1 - carried + index)
        level_of = np.where(rank < FEW, 0, depth)
        level_of[depth < 0] = -1
        place = int(rank[-1])
        for level in range(DEEPEST - DEPTH + 1):
            lead = np.maximum.accumulate(np.where(depth < level, index, 0))
            head = doc[lead]
            if carried:
                # groups that began before this batch keep their head
                opened = np.maximum.accumulate(np.where((depth < level) & (index >= carried), index, -1)) >= 0
                head = np.where(opened, head, heads[level])
            i = index[carried:][level_of[carried:] == level]
            pairs.append((head[i], doc[i]))
            heads[level] = head[-1]
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        once = np.unique(np.stack([lo, hi], axis=1)[lo < hi], axis=0)
        if len(once):
            a, b = np.ascontiguousarray(once[:, 0]), np.ascontiguousarray(once[:, 1])
            yield rows(0, np.zeros(len(a), np.int8), np.zeros(len(a), np.int64), a, b)
        rest = t.slice(len(doc) - 1)
        last = tree[-1:], prefix[-1:], doc[-1:], doc[-1:]
    if last is not None:
        yield rows(2, *last)


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b, trees)`` of ``nodes(doc, signature)``; ``trees``
    counts how often a pair was met."""
    forest = nodes.select("doc", "signature").mapInArrow(_forest_rows, "tree byte, prefix long, deeper long, doc long")
    order = ["tree", "prefix", "deeper", "doc"]
    met = stored(
        forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "edge byte, part int, tree byte, prefix long, a long, b long"),
        "neighbours",
    )
    # where ranges meet: one row for each range
    w = Window.orderBy("part")
    first = met.where("edge = 1").select("part", "tree", "prefix", "a")
    ends = first.join(met.where("edge = 2").select("part", F.struct("tree", "prefix", "a").alias("end")), "part")
    seam = ends.select("tree", "prefix", "a", F.lag("end").over(w).alias("was")).where("was.tree = tree AND was.prefix = prefix AND was.a <> a")
    pairs = met.where("edge = 0").select("a", "b").unionByName(seam.select(F.least("a", "was.a").alias("a"), F.greatest("a", "was.a").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"))


WALKED = "kind byte, a long, b long, tree byte, prefix long, n long"
#: Kinds of rows of the second walk: a pair, a row of a crowded region, a region at a range's border.
PAIR, CROWDED, BORDER = range(3)


def _walked(kind: int, a, b, tree=None, prefix=None, n=None) -> pa.RecordBatch:
    size = len(a)
    zero = np.zeros(size, np.int64)
    cols = [np.full(size, kind, np.int8), a, b, zero.astype(np.int8) if tree is None else tree, zero if prefix is None else prefix, zero if n is None else n]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=[x.split()[0] for x in WALKED.split(", ")])


class _Regions:
    """The regions of a sorted range: those of more than ``NEXT`` rows and of
    more than one component tell their rows, the range's first and last one
    only their extent, since they may go on in another range."""

    def __init__(self):
        self.first = True
        self.docs: list[np.ndarray] = []  # of the region that the last batch ended in
        self.name = self.least = self.most = None

    def _closed(self) -> Iterator[pa.RecordBatch]:
        n = sum(map(len, self.docs))
        if self.first:
            yield self._border(n)
        elif n > NEXT and self.least != self.most:
            own = np.unique(np.concatenate(self.docs))
            yield _walked(CROWDED, own, own)
        self.first, self.docs = False, []

    def _border(self, n: int) -> pa.RecordBatch:
        return _walked(BORDER, *(np.array([x], np.int64) for x in (self.least, self.most)), np.array([self.name[0]], np.int8), np.array([self.name[1]], np.int64), np.array([n], np.int64))

    def add(self, tree: np.ndarray, prefix: np.ndarray, doc: np.ndarray, comp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])))
        least, most = np.minimum.reduceat(comp, start), np.maximum.reduceat(comp, start)
        size = np.diff(np.append(start, len(doc)))
        at = 0
        if self.docs and self.name == (tree[0], prefix[0]):  # the region goes on
            self.docs.append(doc[: size[0]])
            self.least, self.most = min(self.least, least[0]), max(self.most, most[0])
            at = 1
        if at < len(start):
            if self.docs:
                yield from self._closed()
            if self.first and at < len(start) - 1:  # the range's first region ends in this batch
                self.name, self.least, self.most = (tree[start[at]], prefix[start[at]]), least[at], most[at]
                self.docs = [doc[start[at] : start[at] + size[at]]]
                yield from self._closed()
                at += 1
            inner = np.zeros(len(start), bool)
            inner[at:-1] = (size[at:-1] > NEXT) & (least[at:-1] != most[at:-1])
            own = np.unique(doc[np.repeat(inner, size)])
            if len(own):
                yield _walked(CROWDED, own, own)
            self.name, self.least, self.most = (tree[start[-1]], prefix[start[-1]]), least[-1], most[-1]
            self.docs = [doc[start[-1] :]]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.docs:
            yield self._border(sum(map(len, self.docs)))


def _first_of(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a place holds the least ``order`` (the first of equal ones) of its ``(a, b)``."""
    by = np.lexsort((order, b, a))
    first = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])) if len(by) else np.zeros(0, bool)
    out = np.zeros(len(a), bool)
    out[by[first]] = True
    return out


def _strangers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a < b`` of rows of one region and different components, each row
    with the ``NEXT`` rows before it, if their sketches agree in ``AGREE`` places
    (in crowded regions the pair that agrees most, of a row and a component);
    and the regions that reach beyond this walk."""
    rest: pa.Table | None = None
    regions = _Regions()
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        carried = 0 if rest is None else rest.num_rows
        t = t if rest is None else pa.concat_tables([rest, t])
        tree, prefix, doc, comp = (t.column(n).to_numpy() for n in ("tree", "prefix", "doc", "component"))
        yield from regions.add(tree[carried:], prefix[carried:], doc[carried:], comp[carried:])
        raw, at = flat(t.column("sketch"))
        sketch = raw[at[0] : at[-1]].reshape(len(doc), -1)
        later, earlier, agree = [], [], []
        for k in range(1, NEXT + 1):
            i = np.arange(max(carried, k), len(doc))
            i = i[(tree[i] == tree[i - k]) & (prefix[i] == prefix[i - k]) & (comp[i] != comp[i - k])]
            n = (sketch[i] == sketch[i - k]).sum(axis=1)
            i, n = i[n >= AGREE], n[n >= AGREE]
            later.append(i)
            earlier.append(i - k)
            agree.append(n)
        i, j, n = (np.concatenate(x) for x in (later, earlier, agree))
        # rows of a region of more than NEXT rows are joined exactly afterwards: there the best pair of a row and a component will do
        start = np.append(True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]))
        size = np.diff(np.append(np.flatnonzero(start), len(doc)))[np.cumsum(start) - 1]
        crowded = np.flatnonzero(size[i] > NEXT)
        best = _first_of(doc[i[crowded]], comp[j[crowded]], -n[crowded]) & _first_of(doc[j[crowded]], comp[i[crowded]], -n[crowded])
        keep = np.ones(len(i), bool)
        keep[crowded] = best
        i, j = i[keep], j[keep]
        pairs = np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], axis=1), axis=0)
        if len(pairs):
            yield _walked(PAIR, pairs[:, 0], pairs[:, 1])
        rest = t.slice(max(0, len(doc) - NEXT))
    yield from regions.end()


def strangers(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of different components that are near each other in an order and
    whose signatures agree in ``AGREE`` places or more, by their lowest bytes
    (``kind`` 0), rows of crowded regions (1), and the regions at the ranges'
    borders with their least and greatest component and number of rows (2)."""
    named = comp.select(F.col("node").alias("doc"), "component").hint("merge")
    # documents without links so far are components of their own
    known = nodes.join(named, "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"), "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = flat(b.column(2))
            sketch = raw[at[0] : at[-1]].reshape(-1, VALUES, 4)[:, :: VALUES // SKETCH, 0]
            for rows in _forest_rows(iter([pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["doc", "signature"])])):
                own = pa.array([x.tobytes() for x in sketch], pa.binary())
                place = pa.array(np.tile(np.arange(b.num_rows), TREES))
                cols = [*rows.columns, b.column(1).take(place), own.take(place)]
                yield pa.RecordBatch.from_arrays(cols, names=[*rows.schema.names, "component", "sketch"])

    forest = known.mapInArrow(run, "tree byte, prefix long, deeper long, doc long, component long, sketch binary")
    order = ["tree", "prefix", "deeper", "doc"]
    return forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_strangers, WALKED)


def crowded_rows(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """``doc`` of the rows that may have similar ones of another component
    beyond the second walk: those of regions of more than ``NEXT`` rows, or cut
    by the border of a range, that hold more than one component."""
    border = walked.where(F.col("kind") == BORDER).groupBy("tree", "prefix")
    border = border.agg(F.count(F.lit(1)).alias("ranges"), F.sum("n").alias("n"), F.min("a").alias("least"), F.max("b").alias("most"))
    cut = border.where(((F.col("ranges") > 1) | (F.col("n") > NEXT)) & (F.col("least") != F.col("most"))).select("tree", "prefix")
    wanted = [np.zeros(0, np.int64)] * TREES
    regions = cut.collect()  # no more than two regions for each range
    for t in {r.tree for r in regions}:
        wanted[t] = np.array([r.prefix for r in regions if r.tree == t], np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.zeros(b.num_rows, bool)
            for rows in _forest_rows(iter([b])):
                prefix = rows.column(1).to_numpy().reshape(TREES, -1)
                for t, own in enumerate(shared.value):
                    if len(own):
                        hit |= np.isin(prefix[t], own)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit))], names=["doc"])

    inner = walked.where(F.col("kind") == CROWDED).select(F.col("a").alias("doc"))
    return inner.unionByName(nodes.select("doc", "signature").mapInArrow(run, "doc long")).distinct()


def node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc, shingles)`` of the documents in ``wanted(doc)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shingles = Rolling(4), Rolling(5)
        for b in batches:
            raw, at = flat(b.column(1))
            for lo, hi in slabs(at):
                sets = shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words, shingles)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])

    # both sides grow with the corpus: never broadcast
    return named_texts(docs).join(wanted.hint("merge"), "doc", "left_semi").mapInArrow(run, "doc long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, oa = flat(b.column(2))
            rb, ob = flat(b.column(3))
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = ra[oa[i] : oa[i + 1]].view(np.uint64), rb[ob[i] : ob[i + 1]].view(np.uint64)
                if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def prefix_pairs(sets: DataFrame, crowded: DataFrame, comp: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """All pairs ``a < b`` of ``crowded(doc)`` and different components that can
    be similar enough: a prefix-filter join.

    Shingles are ordered by how many of these sets have them, those of one
    component first, since no pair needs them.  Sets of ``n`` and ``m`` shingles
    are similar enough if they share ``s (n + m) / (100 + s)``; so many must be
    left from their first common shingle on.  ``reach`` is the largest set a row
    can meet so at that place.  The smaller set of a pair meets sets of its own
    size at least, which leaves one seventh of its shingles at 75 hundredths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = flat(b.column(2))
            for lo, hi in slabs(at):
                n = np.diff(at[lo : hi + 1]) // 8
                of = [np.repeat(x, n) for x in (b.column(0).to_numpy()[lo:hi], b.column(1).to_numpy()[lo:hi], n)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, of), pa.array(raw[at[lo] : at[hi]].view(np.int64))], names=["doc", "component", "n", "shingle"]
                )

    named = comp.select(F.col("node").alias("doc"), "component").hint("merge")
    chosen = sets.join(crowded.hint("merge"), "doc", "left_semi").join(named, "doc", "left")
    rows = chosen.select("doc", F.coalesce("component", "doc").alias("component"), "shingles")
    rows = stored(rows.mapInArrow(run, "doc long, component long, n long, shingle long"), "shingles")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    held = held.where("lo <> hi").select("shingle", "holders")
    common = rows.join(held.hint("merge"), "shingle")
    of_doc = common.groupBy("doc", "component", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("l"))
    # by place of the least shingle of ``l``: ``n`` less those of ``l``
    spread = of_doc.select("doc", "component", "n", F.size("l").alias("k"), F.posexplode("l"))
    left = F.col("k") - F.col("pos")
    reach = F.floor(left * (100 + similarity) / similarity).cast("long") - F.col("n")
    least = F.ceil(F.col("n") * similarity / 100)
    front = stored(spread.select("doc", "component", "n", reach.alias("reach"), "col.shingle").where(F.col("reach") >= least), "front")
    small = front.where("reach >= n").select("shingle", *(F.col(c).alias(f"{c}_s") for c in ("doc", "component", "n", "reach")))
    meet = (
        (F.col("component") != F.col("component_s"))
        & (F.struct("n", "doc") > F.struct("n_s", "doc_s"))
        & (F.col("n") <= F.col("reach_s"))
        & (F.col("n_s") <= F.col("reach"))
    )
    pairs = front.join(small.hint("merge"), "shingle").where(meet)
    return pairs.select(F.least("doc", "doc_s").alias("a"), F.greatest("doc", "doc_s").alias("b")).distinct()


def linked_components(docs: DataFrame, nodes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``(node, component)`` of the nodes with links."""
    pairs = stored(candidates(nodes), "pairs")
    sets = stored(node_sets(docs, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()), "sets")
    # first the best candidate of each document, then all that are left across components
    best = F.max_by(F.struct("a", "b"), F.struct("trees", -F.col("b"), -F.col("a")))
    chosen = pairs.groupBy("b").agg(best.alias("p")).select("p.a", "p.b")
    links = stored(confirmed(chosen, sets, similarity), "links")
    comp = components(links)
    across = (
        pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    )
    links = links.unionByName(stored(confirmed(across, sets, similarity), "links"))
    comp = components(links)
    met = nodes.join(sets.select("doc").hint("merge"), "doc", "left_semi")  # the others share no region with any
    walked = stored(strangers(met, comp), "strangers")
    far = walked.where(F.col("kind") == PAIR).select("a", "b").distinct().join(pairs.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    links = links.unionByName(stored(confirmed(far, sets, similarity), "links"))
    out = components(links)
    crowded = stored(crowded_rows(met, walked), "crowded")
    rest = stored(confirmed(prefix_pairs(sets, crowded, out, similarity), sets, similarity), "links")
    if rest.limit(1).count():
        out = components(links.unionByName(rest))
    drop_stored(pairs, sets)
    return out


def near_dedup(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``;
    the smallest ``doc_id`` of a component is kept."""
    sigs = stored(signatures(docs), "signatures")
    full = sigs.where("n_shingles > 0")
    heads = stored(full.groupBy("digest").agg(F.min("doc").alias("node")), "set-heads")
    nodes = full.join(heads.select(F.col("node").alias("doc")).hint("merge"), "doc", "left_semi")
    comp = linked_components(docs, nodes, similarity)
    of_set = heads.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = sigs.select("doc", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc"))
    named = lambda c: F.when(c != NO_DOC, c)
    return rows.select(
        named(F.col("doc")).alias("doc_id"), "n_shingles", named(component).alias("component_id"), (F.col("doc") == component).alias("kept")
    )
