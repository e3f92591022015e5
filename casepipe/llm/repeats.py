"""What both repeat finders share: segments of texts as rows, the texts of
chosen segments, and the comparison of their windows to full depth.

A row is named by ``doc`` (its ``doc_id``, null as the least long) and ``tag``
(a hash of its text), so rows that repeat an id, or have none, keep to
themselves; rows that repeat both have the same text and the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import SEPARATOR, SLAB, Rolling, flat, hash_words, slabs, stored, text_or_empty, word_bounds
from casepipe.llm.sampling import pieces, segments

NO_DOC = -(1 << 63)
#: Groups of at most this many distinct segments (some 3 MB of text, and 100 MB
#: while they are compared) are compared in one task;
#: the windows of larger ones are dealt out by their own hash.
GROUP_LIMIT = 10_000
#: Segments that one numpy pass compares, about.
COMPARED = 4000
OCCURRENCE = "doc long, tag long, lo int, hi int, gram long, extent long"
WINDOWS = "gram long, extent long, doc long, tag long, lo int, first int, last int"


class Scheme(NamedTuple):
    """Windows of ``length`` symbols (words, or bytes), anchored on ``k``-grams."""

    length: int
    k: int
    words: bool


def doc_name(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NO_DOC))


def text_tag() -> Column:
    return F.xxhash64(text_or_empty(), F.octet_length(text_or_empty()))


def named_texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_name().alias("doc"), text_or_empty().alias("text"))


def tagged_texts(docs: DataFrame) -> DataFrame:
    return docs.select(doc_name().alias("doc"), text_tag().alias("tag"), text_or_empty().alias("text"))


def word_hashes(raw: np.ndarray, at: np.ndarray, hashes: tuple[Rolling, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of texts under each hash, and the texts' offsets in words.
    A long text is hashed chunk by chunk, each chunk up to a separator."""
    if len(at) > 2 or len(raw) <= 2 * SLAB:
        lo, hi = word_bounds(raw, at)
        return [hash_words(raw, lo, hi, h.seed) for h in hashes], np.searchsorted(lo, at)
    gaps, out, lo = SEPARATOR[raw], [], 0
    while lo < len(raw):
        hi = lo + SLAB
        hi = hi + int(gaps[hi:].argmax()) if hi < len(raw) and gaps[hi:].any() else len(raw)
        begin, end = word_bounds(raw[lo:hi], np.array([0, hi - lo]))
        out.append([hash_words(raw[lo:hi], begin, end, h.seed) for h in hashes])
        lo = hi
    words = [np.concatenate(x) for x in zip(*out, strict=True)]
    return words, np.array([0, len(words[0])])


def _parts(scheme: Scheme, raw: np.ndarray, at: np.ndarray, hashes: tuple[Rolling, Rolling]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(symbols before, symbols by either hash, text offsets)``; long texts
    come in overlapping parts."""
    if scheme.words:
        (a, b), off = word_hashes(raw, at, hashes)
        for lo, hi in [(0, len(a))] if len(at) > 2 else pieces(len(a), scheme.length, 2 * SLAB):
            yield lo, a[lo:hi], b[lo:hi], off if len(at) > 2 else np.array([0, hi - lo])
        return
    for lo, hi in [(0, len(raw))] if len(at) > 2 else pieces(len(raw), scheme.length, 2 * SLAB):
        own = raw[lo:hi]
        yield lo, hashes[0].symbol[own], hashes[1].symbol[own], at if len(at) > 2 else np.array([0, len(own)])


def occurrences(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """One row per segment of every text: its names, the first and the last
    window start, and the hashes of the anchor's gram and of the extent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Rolling(1), Rolling(2)
        for batch in batches:
            raw, at = flat(batch.column(2))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in slabs(at):
                for before, a, b, own in _parts(scheme, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], hashes):
                    s = segments(a, b, own, scheme.length, scheme.k, *hashes)
                    if len(s.lo):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[lo + s.text]),
                                pa.array(tags[lo + s.text]),
                                pa.array((s.lo + before).astype(np.int32)),
                                pa.array((s.hi + before).astype(np.int32)),
                                pa.array(s.gram.view(np.int64)),
                                pa.array(s.extent.view(np.int64)),
                            ],
                            names=["doc", "tag", "lo", "hi", "gram", "extent"],
                        )

    return tagged_texts(docs).mapInArrow(run, OCCURRENCE)


def repeated_grams(occ: DataFrame) -> DataFrame:
    """Occurrences whose anchor's gram is another one's too, with ``mixed``:
    whether the gram has more than one extent.  The counts are aggregated
    before the shuffle, and the join may split a hot gram."""
    groups = (
        occ.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), F.min("extent").alias("least"), F.max("extent").alias("most"))
        .where("n > 1")
        .select("gram", (F.col("least") != F.col("most")).alias("mixed"))
    )
    # written first: only a join of two plain exchanges can be split where a gram is hot
    return occ.join(stored(groups, "grams").hint("merge"), "gram")


def segment_texts(docs: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """The text of segments: ``wanted(gram, extent, doc, tag, lo, hi, large)``
    gets ``part``, the bytes from its first window's start to its last one's end."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("gram", "extent", "lo", "hi", "large")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = flat(batch.column(2))
            for i in range(batch.num_rows):
                own = raw[at[i] : at[i + 1]]
                flat_segs = batch.column(3)[i].values
                names = ["gram", "extent", "lo", "hi", "large"]
                gram, extent, lo, hi, large = (flat_segs.field(n) for n in names)
                first, last = lo.to_numpy(), hi.to_numpy() + scheme.length
                if scheme.words:
                    begin, end = word_bounds(own, np.array([0, len(own)]))
                    keep = last <= len(begin)
                    first, last = begin[first[keep]], end[last[keep] - 1]
                else:
                    keep = last <= len(own)
                    first, last = first[keep], last[keep]
                took = pa.array(keep)
                parts = [own[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                cols = [x.filter(took) for x in (gram, extent, lo, hi, large)]
                name = [pa.array([batch.column(c)[i].as_py()] * len(parts), pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, *name, pa.array(parts, pa.binary())], names=[*names, "doc", "tag", "part"])

    joined = tagged_texts(docs).join(lists, ["doc", "tag"]).select("doc", "tag", "text", "segs")
    return joined.mapInArrow(run, "gram long, extent long, lo int, hi int, large boolean, doc long, tag long, part binary")


class _Windows(NamedTuple):
    segment: np.ndarray  # number of the window's segment
    offset: np.ndarray  # from its segment's first window
    hash: np.ndarray


def _windows(parts: pa.Array, count: np.ndarray, scheme: Scheme, h: Rolling) -> _Windows:
    """All windows of segments of ``count`` windows each."""
    raw, at = flat(parts)
    raw, at = raw[at[0] : at[-1]], at - at[0]
    if scheme.words:
        lo, hi = word_bounds(raw, at)
        symbols = hash_words(raw, lo, hi, h.seed)
        base = np.searchsorted(lo, at[:-1])
    else:
        symbols, base = h.symbol[raw], at[:-1]
    segment = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    start = base[segment] + offset
    prefix = h.prefix(symbols)
    return _Windows(segment, offset, h.slices(prefix, start, start + scheme.length))


def _flagged(w: _Windows, group: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """Which windows another segment of the group has too: any other one, or
    (with ``rank``) one of lower rank."""
    g = group[w.segment]
    order = np.lexsort((w.hash, g))
    new = np.ones(len(order), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    out = np.zeros(len(order), bool)
    if rank is None:
        out[order] = np.repeat(sizes > 1, sizes)
    else:
        own = rank[w.segment][order]
        out[order] = own > np.repeat(np.minimum.reduceat(own, starts), sizes)
    return out


def shared_windows(parts: DataFrame, scheme: Scheme, by_rank: bool) -> DataFrame:
    """Runs of windows (``first`` to ``last``, from the segment's first window)
    that another segment of the same gram has as well; with ``by_rank``, a
    segment of a document with a smaller number.

    Small groups are sorted to full depth inside one task, many groups at
    once.  The windows of large groups are rows, grouped by their own hash.
    """
    names = ["gram", "extent", "doc", "tag", "lo", "first", "last"]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Rolling(3)
        rest: pa.Table | None = None

        def compared(t: pa.Table) -> pa.RecordBatch:
            b = t.combine_chunks().to_batches()[0]
            gram, extent, lo, hi = (b.column(n).to_numpy() for n in ("gram", "extent", "lo", "hi"))
            once = np.ones(len(gram), bool)  # rows that repeat id and text bring a segment twice
            once[1:] = (gram[1:] != gram[:-1]) | (extent[1:] != extent[:-1])
            b = b.filter(pa.array(once))
            gram, extent, lo, hi = gram[once], extent[once], lo[once], hi[once]
            doc, tag = b.column("doc").to_numpy(), b.column("tag").to_numpy()
            w = _windows(b.column("part"), hi - lo + 1, scheme, h)
            group = np.cumsum(np.append(0, gram[1:] != gram[:-1]))
            on = _flagged(w, group, doc if by_rank else None)
            edge = w.offset == 0
            begin = on & (edge | np.append(True, ~on[:-1]))
            stop = on & np.append(edge[1:] | ~on[1:], True)
            s, first, last = w.segment[begin], w.offset[begin], w.offset[stop]
            cols = [gram[s], extent[s], doc[s], tag[s], lo[s], first.astype(np.int32), last.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows >= COMPARED:
                gram = rest.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on in the next batch
                if cut:
                    yield compared(rest.slice(0, cut))
                    rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield compared(rest)

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Rolling(3)
        for b in batches:
            for i in range(0, b.num_rows, COMPARED):
                p = b.slice(i, COMPARED)
                w = _windows(p.column("part"), p.column("hi").to_numpy() - p.column("lo").to_numpy() + 1, scheme, h)
                took = pa.array(w.segment)
                cols = [p.column(n).take(took) for n in names[:5]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(w.offset.astype(np.int32)), pa.array(w.hash.view(np.int64))], names=[*names[:6], "window"])

    few = parts.where(~F.col("large")).drop("large").repartition("gram").sortWithinPartitions("gram", "extent").mapInArrow(small, WINDOWS)
    rows = parts.where("large").dropDuplicates(["gram", "extent"]).mapInArrow(large, "gram long, extent long, doc long, tag long, lo int, first int, window long")
    told = rows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
    own = rows.join(told, ["gram", "window"]).where(F.col("doc") > F.col("least") if by_rank else F.col("n") > 1)
    return few.unionByName(own.select("gram", "extent", "doc", "tag", "lo", "first", F.col("first").alias("last")))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs ``[lo, hi)`` that cover the ranges ``[first, last)``; ranges that touch make one run."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    starts = np.flatnonzero(new)
    return first[starts], last[np.append(starts[1:], len(first)) - 1]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)`` of every row; ``spans(doc, tag, lo, hi)`` are ranges of window starts."""
    lists = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    d = docs.select(doc_name().alias("doc"), text_tag().alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return d.join(lists, ["doc", "tag"], "left").select("doc_id", "text", "spans")
