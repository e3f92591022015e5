"""Substring de-duplication on a compacted de Bruijn graph of word k-mers.

The nodes are anchor k-mers of ``GRAM`` words (``casepipe.llm.sampling`` picks
at least one in every window of ``LENGTH`` words), an edge is the stretch of
words of all windows with one anchor, and consecutive edges of a text are
linked.  Spark joins give every edge its count, its source (the smallest
document and place) and its neighbours; edges that have one and the same
neighbour wherever they occur are not branching, and runs of them compact
into one path per occurrence.  A path occurrence in a document other than the
source's is removed as a whole.

Where the graph branches, an edge's windows may occur on other edges of the
same k-mer.  Their words are fetched at the source coordinates and compared
window by window, so the result is exact.

Defined cases: null text has no words; texts shorter than a window stay whole;
rows that repeat a ``doc_id`` are each judged on their own text, and none of
them is smaller than another; null ids are equal to each other and smaller than
all others; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casepipe.llm.common import drop_stored, flat, stored
from casepipe.llm.repeats import GROUP_LIMIT, Scheme, merged, occurrences, repeated_grams, segment_texts, shared_windows, with_spans

LENGTH = 50
GRAM = 12


def linked_edges(hits: DataFrame) -> DataFrame:
    """Edges with the extents of the edges before and after them in their
    text; null where the text ends or the neighbour does not repeat."""
    w = Window.partitionBy("doc", "tag").orderBy("lo")
    before, after = F.lag(F.struct("hi", "extent")).over(w), F.lead(F.struct("lo", "extent")).over(w)
    return hits.select(
        "*",
        F.when(before["hi"] + 1 == F.col("lo"), before["extent"]).alias("before"),
        F.when(after["lo"] == F.col("hi") + 1, after["extent"]).alias("after"),
    )


def edge_table(edges: DataFrame) -> DataFrame:
    """Per distinct edge: count, source, and whether one and the same edge
    comes before (``joined_left``) and after (``joined_right``) it everywhere."""
    n = F.count(F.lit(1))
    same = lambda c: (F.count(c) == n) & (F.min(c) == F.max(c))
    return edges.groupBy("gram", "extent").agg(
        n.alias("n"),
        F.min(F.struct("doc", "tag", "lo", "hi")).alias("source"),
        same("before").alias("joined_left"),
        same("after").alias("joined_right"),
    )


def paths(edges: DataFrame) -> DataFrame:
    """Occurrences of compacted paths of repeated edges: ``(doc, tag, lo, hi, source_doc)``."""
    w = Window.partitionBy("doc", "tag").orderBy("lo")
    before = F.lag(F.struct("hi", "joined_right", "source")).over(w)
    follows = (before["hi"] + 1 == F.col("lo")) & before["joined_right"] & F.col("joined_left") & (before["source"]["doc"] == F.col("source")["doc"])
    numbered = edges.select("*", F.sum(F.when(follows, 0).otherwise(1)).over(w).alias("path"))
    return numbered.groupBy("doc", "tag", "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("source.doc").alias("source_doc"))


def copied_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc, tag, lo, hi)``: starts, from ``lo`` to ``hi``, of windows of words that a smaller document has."""
    scheme = Scheme(length, gram, words=True)
    occ = stored(occurrences(docs, scheme), "k-mers")
    hits = stored(linked_edges(repeated_grams(occ)), "edges")
    drop_stored(occ)
    table = stored(edge_table(hits), "edge-table")
    repeated = hits.select("gram", "extent", "doc", "tag", "lo", "hi").join(table.where("n > 1"), ["gram", "extent"])
    whole = paths(repeated).where("source_doc < doc").select("doc", "tag", "lo", "hi")
    # branching nodes: distinct edges of one k-mer
    sizes = table.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    wanted = table.join(sizes, "gram").select("gram", "extent", "source.*", (F.col("members") > group_limit).alias("large"))
    parts = stored(segment_texts(docs, wanted, scheme), "segments")
    runs = shared_windows(parts, scheme, by_rank=True).drop("lo", "tag")
    at_source = hits.where("mixed").select("gram", "extent", "doc", "tag", "lo").join(runs, ["gram", "extent", "doc"])
    fine = at_source.select("doc", "tag", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi"))
    out = stored(whole.unionByName(fine), "spans")
    drop_stored(hits, table, parts)
    return out


def remove_copied(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of each document; with
    ``keep_text`` also ``kept``, the remaining words joined by blanks."""
    rows = with_spans(docs, copied_spans(docs, length, gram, group_limit))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, digest, kept = [], [], [], []
            for i in range(b.num_rows):
                words = b.column(1)[i].as_py().encode().split()
                total.append(len(words))
                gone = 0
                if b.column(2)[i].is_valid:
                    s = b.column(2)[i].values
                    lo, hi = merged(s.field("lo").to_numpy(), np.minimum(s.field("hi").to_numpy() + length, len(words)))
                    for x, y in zip(lo[::-1].tolist(), hi[::-1].tolist(), strict=True):
                        del words[x:y]
                        gone += y - x
                removed.append(gone)
                text = b" ".join(words)
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text)
            cols = [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if keep_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)
