"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every window of ``LENGTH`` bytes is a suffix cut at threshold depth.  Most
significant digit passes put suffixes that agree so far into one group and
let groups of one go; a group that still agrees at full depth is a string
that starts in several places.

1. The first digit of a suffix is its anchor's gram of ``GRAM`` bytes, at its
   offset (``casepipe.llm.sampling``): the order of digits does not matter for
   equality, and suffixes with a common anchor share one row.  Grams that
   occur once go.
2. The second digit is the extent of all windows with that anchor: where it is
   equal, all their suffixes are equal to full depth.
3. The rest is compared through byte ``LENGTH``: one row for each distinct
   extent is enough, and its text is fetched from its document.

Defined cases: null text is empty; texts shorter than ``LENGTH`` bytes stay
whole; rows that repeat a ``doc_id``, or have none, are each judged and cut on
their own text; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import drop_stored, flat, stored
from casepipe.llm.repeats import GROUP_LIMIT, Scheme, merged, occurrences, repeated_grams, segment_texts, shared_windows, with_spans

LENGTH = 200
GRAM = 50


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc, tag, lo, hi)``: starts, from ``lo`` to ``hi``, of windows that occur elsewhere."""
    scheme = Scheme(length, gram, words=False)
    occ = stored(occurrences(docs, scheme), "suffixes")
    first = stored(repeated_grams(occ), "first-digit")
    drop_stored(occ)
    mixed = first.where("mixed")
    second = stored(
        mixed.groupBy("gram", "extent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag", "lo", "hi")).alias("at")),
        "second-digit",
    )
    sizes = second.groupBy("gram").agg(F.count(F.lit(1)).alias("members"))
    wanted = second.join(sizes, "gram").select("gram", "extent", "at.*", (F.col("members") > group_limit).alias("large"))
    parts = stored(segment_texts(docs, wanted, scheme), "segments")
    single = second.where("n = 1").select("gram", "extent")
    several = second.where("n > 1").select("gram", "extent")
    deep = shared_windows(parts, scheme, by_rank=False).join(single, ["gram", "extent"], "left_semi")
    spans = first.where(~F.col("mixed")).select("doc", "tag", "lo", "hi")
    spans = spans.unionByName(mixed.join(several, ["gram", "extent"], "left_semi").select("doc", "tag", "lo", "hi"))
    spans = spans.unionByName(deep.select("doc", "tag", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi")))
    out = stored(spans, "spans")
    drop_stored(first, second, parts)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each document;
    with ``keep_text`` also ``kept``, the remaining bytes."""
    rows = with_spans(docs, repeated_spans(docs, length, gram, group_limit))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = flat(b.column(1))
            removed, n_spans, digest, kept = [], [], [], []
            for i in range(b.num_rows):
                own = raw[at[i] : at[i + 1]]
                if b.column(2)[i].is_valid:
                    s = b.column(2)[i].values
                    lo, hi = merged(s.field("lo").to_numpy(), np.minimum(s.field("hi").to_numpy() + length, len(own)))
                    bounds = np.concatenate([[0], np.stack([lo, hi], axis=1).ravel(), [len(own)]]).tolist()
                    text = b"".join(own[x:y].tobytes() for x, y in zip(bounds[::2], bounds[1::2], strict=True))
                    removed.append(int((hi - lo).sum()))
                    n_spans.append(len(lo))
                else:
                    text = own.tobytes()
                    removed.append(0)
                    n_spans.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text)
            cols = [b.column(0), pa.array(at[1:] - at[:-1]), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            if keep_text:
                cols.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)
