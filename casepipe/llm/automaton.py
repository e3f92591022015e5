"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items make one suffix automaton.  Training
texts are streamed through it; the automaton's state and the longest matching
length at each word tell which windows of item words end there.  Words inside
a match of at least ``window`` words (or inside a whole shorter item) are hit.

Words become vocabulary numbers with array operations (``words.WordTable``,
decided on the words' bytes), and only stretches in which every pair of
neighbours is a pair of some item are walked word by word: outside them the
matching length is at most one word and no window ends.

The automaton is broadcast in blocks of at most ``BLOCK_WORDS`` item words,
counted before, so what is broadcast is bound.  One block marks, and cuts, in
the same pass that reads the texts.  With more blocks every further one has a
pass over the texts that gives rows for the documents it hits only.

Defined cases: null text has no words (documents: 0 words, not contaminated;
items: never found); an item with no words is never found; items that repeat
an id count once; null ids of items read ``null``; an empty benchmark hits
nothing; an empty table gives no row; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import flat, slabs, stored
from casepipe.llm.words import WordTable, words_of

WINDOW = 10
BLOCK_WORDS = 200_000
Span = tuple[int, int, int, int]


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        """``items``: the words of each item."""
        self.window = window
        self.words = WordTable(chain.from_iterable(items))
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        rows = [[self.words.number[w] for w in x] for x in items]
        for row in rows:
            last = 0
            for w in row:
                last = self._extend(last, w)
        self.items_of: dict[int, set[int]] = {}
        self.short_at: dict[int, list[tuple[int, int]]] = {}
        for k, row in enumerate(rows):
            state = size = 0
            for w in row:
                state, size = self.step(state, size, w)
                if size >= window:
                    self.items_of.setdefault(self.top(state, window), set()).add(k)
            if 0 < len(row) < window:
                self.short_at.setdefault(self.top(state, len(row)), []).append((len(row), k))
        self.least = min([min(len(r), window) for r in rows if r], default=window)
        pairs = [r[i] << 32 | r[i + 1] for r in rows for i in range(len(r) - 1)]
        self.pairs = np.unique(np.array(pairs, np.int64))

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """State and matching length after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        q = self.next[state].get(w)
        return (0, 0) if q is None else (q, size + 1)

    def top(self, state: int, size: int) -> int:
        """The state of the matched text's last ``size`` words."""
        while self.length[self.link[state]] >= size and self.link[state] > 0:
            state = self.link[state]
        return state

    def scan(self, words: list[int], hit: np.ndarray, base: int, found: set[int]) -> None:
        """Mark in ``hit`` (from ``base``) the words inside item windows; add the items to ``found``."""
        state = size = 0
        for i, w in enumerate(words):
            state, size = self.step(state, size, w)
            if size >= self.window:
                hit[base + i - self.window + 1 : base + i + 1] = True
                found |= self.items_of[self.top(state, self.window)]
            if self.short_at:
                u = state
                while u > 0:
                    for n, k in self.short_at.get(u, ()):
                        if size >= n:
                            hit[base + i - n + 1 : base + i + 1] = True
                            found.add(k)
                    u = self.link[u]


def _item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list[str], list[list[bytes]]]]:
    """Items in blocks of bounded size, one block on the driver at a time."""
    ids, words, total = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text")
    for row in rows.toLocalIterator():
        own = words_of(row["text"])
        if not own:
            continue
        if words and total + len(own) > block_words:
            yield ids, words
            ids, words, total = [], [], 0
        ids.append(row["i"])
        words.append(own)
        total += len(own)
    if words:
        yield ids, words


def _scanned(shared, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, list[Span]], dict[int, set[str]]]:
    """The number of words of each text; by hit text, its spans inside item
    windows (byte start and end, first word, word after the last) and the items."""
    ids, auto = shared
    spans: dict[int, list[Span]] = {}
    items: dict[int, set[str]] = {}
    k, begin, end, first = auto.words.located(raw, at)
    if not len(k) or not len(auto.words):
        return np.diff(first), spans, items
    known = k >= 0
    # a word follows on if it is known and makes a pair of an item with the word before it, in one text
    on = np.zeros(len(k), bool)
    if len(auto.pairs):
        pair = k[:-1].astype(np.int64) << 32 | k[1:].astype(np.int64)
        p = np.minimum(np.searchsorted(auto.pairs, pair), len(auto.pairs) - 1)
        on[1:] = known[:-1] & known[1:] & (auto.pairs[p] == pair)
    on[first[:-1][first[:-1] < len(k)]] = False
    starts = np.flatnonzero(known & ~on)
    stops = np.flatnonzero(known & ~np.append(on[1:], False)) + 1
    long = stops - starts >= auto.least
    for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
        hit, found = np.zeros(e - s, bool), set()
        auto.scan(k[s:e].tolist(), hit, 0, found)
        if found:
            d = int(np.searchsorted(first, s, "right")) - 1
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            byte, word = int(at[d]), int(first[d])
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                spans.setdefault(d, []).append((int(begin[s + x]) - byte, int(end[s + y - 1]) - byte, s + x - word, s + y - word))
            items.setdefault(d, set()).update(ids[i] for i in found)
    return np.diff(first), spans, items


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of bounded text size, with their texts as bytes."""
    raw, at = flat(batch.column(text))
    for lo, hi in slabs(at):
        yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def _merged(spans: list[Span]) -> list[Span]:
    """Spans of several blocks as disjoint ones, in order; those that touch are one."""
    out: list[list[int]] = []
    for x in sorted(map(tuple, spans)):
        if out and x[2] <= out[-1][3]:
            if x[3] > out[-1][3]:
                out[-1][1], out[-1][3] = x[1], x[3]
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


_SPANS = pa.list_(pa.list_(pa.int64()))
_ITEMS = pa.list_(pa.string())
MARKED = "n_words long, spans array<array<bigint>>, items array<string>"


def _mark(docs: DataFrame, key: str, shared, hit_only: bool) -> DataFrame:
    """``(key, n_words, spans, items)`` of the documents of ``docs(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw, at in _slices(batch, 1):
                n_words, spans, items = _scanned(shared.value, raw, at)
                cols = [
                    b.column(0),
                    pa.array(n_words),
                    pa.array([spans.get(i, []) for i in range(b.num_rows)], _SPANS),
                    pa.array([sorted(items.get(i, ())) for i in range(b.num_rows)], _ITEMS),
                ]
                out = pa.RecordBatch.from_arrays(cols, names=[key, "n_words", "spans", "items"])
                yield out.take(pa.array(sorted(spans), pa.int64())) if hit_only else out

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {MARKED}")


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> Iterator:
    """Broadcast automata, one per block of items; one at least."""
    sent = 0
    for ids, words in _item_blocks(benchmark, block_words):
        yield docs.sparkSession.sparkContext.broadcast((ids, SuffixAutomaton(words, window)))
        sent += 1
    if not sent:
        yield docs.sparkSession.sparkContext.broadcast(([], SuffixAutomaton([], window)))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a row key, in a column of a name of its own."""
    key = "row"
    while key in docs.columns:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate"), key


def _marked_by_all(rows: DataFrame, key: str, blocks: Iterator, hit_only: bool) -> DataFrame:
    """``(key, n_words, spans, items)``, the results of all blocks in one row."""
    parts = [stored(_mark(rows, key, shared, hit_only or i > 0), "contamination") for i, shared in enumerate(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` of each document: its number of
    words, the spans inside item windows (byte start, byte end, first word,
    word after the last; those of several blocks may overlap) and the sorted
    ids of the items found."""
    blocks = _blocks(docs, benchmark, window, block_words)
    one, two = next(blocks), next(blocks, None)
    if two is None:
        return _mark(docs, "doc_id", one, False)
    rows, key = _keyed(docs.select("doc_id", "text"))
    marked = _marked_by_all(rows, key, chain([one, two], blocks), False)
    return rows.select(key, "doc_id").join(marked, key).select("doc_id", "n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids, spans)`` of each document; ``spans``
    are disjoint byte ranges ``(start, end)`` of hit words."""
    m = mark_contamination(docs, benchmark, window, block_words)
    # spans in order of their first word; those that overlap or touch are one
    order = F.array_sort("spans", lambda x, y: F.when(x[2] != y[2], F.signum(x[2] - y[2]).cast("int")).otherwise(F.signum(x[3] - y[3]).cast("int")))
    last = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,from:bigint,to:bigint>>")

    def joined(acc: F.Column, x: F.Column) -> F.Column:
        before = F.coalesce(F.element_at(acc, -1), last)
        new = F.struct(x[0].alias("start"), x[1].alias("end"), x[2].alias("from"), x[3].alias("to"))
        longer = F.struct(before["start"].alias("start"), x[1].alias("end"), before["from"].alias("from"), x[3].alias("to"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) == 0) | (x[2] > before["to"]), F.concat(acc, F.array(new))).when(x[3] > before["to"], F.concat(head, F.array(longer))).otherwise(acc)

    runs = F.aggregate(order, none, joined)
    d = m.withColumn("runs", F.when(F.size("spans") == 0, none).otherwise(runs))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    spans = F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.col("items").alias("item_ids"), spans.alias("spans"))


def _cut(text: bytes, spans: list[Span]) -> str:
    parts, at = [], 0
    for x in spans:
        parts.append(text[at : x[0]])
        at = x[1]
    return b"".join([*parts, text[at:]]).decode()


def _without(b: pa.RecordBatch, text: int, spans: dict[int, list[Span]], n_words: dict[int, int], max_coverage: float) -> pa.RecordBatch:
    """A batch with the hit texts cut, and without rows that are covered for the most part."""
    rows = sorted(spans)
    merged = {i: _merged(spans[i]) for i in rows}
    texts = b.column(text)
    hit = np.zeros(b.num_rows, bool)
    hit[rows] = True
    keep = np.ones(b.num_rows, bool)
    keep[[i for i in rows if sum(x[3] - x[2] for x in merged[i]) > max_coverage * n_words[i]]] = False
    new = pa.array([_cut(texts[i].as_py().encode(), merged[i]) for i in rows], texts.type)
    cols = [pc.replace_with_mask(texts, pa.array(hit), new) if j == text else c for j, c in enumerate(b.columns)]
    return pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with every span removed that lies inside an item
    window; documents of which more than ``max_coverage`` of the words are
    hit go.  Texts without a hit (null ones too) stay as they are."""
    blocks = _blocks(docs, benchmark, window, block_words)
    one, two = next(blocks), next(blocks, None)
    text = docs.columns.index("text")

    if two is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, raw, at in _slices(batch, text):
                    n_words, spans, _ = _scanned(one.value, raw, at)
                    yield _without(b, text, spans, n_words, max_coverage) if spans else b

        return docs.mapInArrow(run, docs.schema)

    rows, key = _keyed(docs)
    hits = _marked_by_all(rows, key, chain([one, two], blocks), True)
    told = rows.join(hits.select(F.col(key), F.struct("spans", "n_words").alias(f"{key}_hit")), key, "left").select(*docs.columns, f"{key}_hit")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, _ in _slices(batch, text):
                found = {i: x for i, x in enumerate(b.column(b.num_columns - 1).to_pylist()) if x is not None}
                b = b.select(list(range(b.num_columns - 1)))
                spans, n_words = ({i: x[c] for i, x in found.items()} for c in ("spans", "n_words"))
                yield _without(b, text, spans, n_words, max_coverage) if found else b

    return told.mapInArrow(cut, docs.schema)
