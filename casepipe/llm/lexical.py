"""Ranked lexical search with the Best Position Algorithm.

A document's score for an item is the sum, over the item's distinct terms, of
the term's *impact* in it (see ``Collection.impact``).  Documents stay in the
ranges they are read in.  Each range is taken in shards; a shard holds one list
per term, its documents by falling impact, and finds an item's best documents
so: all lists are read downwards in step; every document met is looked up
directly in the item's other lists, which gives its score and its position in
each; the best position of a list is the end of its unbroken run of positions
seen from the top, by reading or by look-up.  No unseen document can score more
than the sum of the impacts at the best positions, so a search ends when that
sum is strictly below the k-th score (equal ones might win by their id).
A list that is seen to its end adds nothing.  The positions are read in blocks
of growing size, and the k-th score carries over to a range's next shard.

Two passes: the first reads all texts, counts their terms and keeps those that
items ask for, as one slim row per document; the second searches.  Only each
range's best ``k`` per item are shuffled.  Items come in blocks of at most
``BLOCK_TERMS`` distinct terms, counted before; a block's terms and weights are
what is broadcast.

Defined cases: null and empty texts have no terms and are never found; items
without terms, or whose terms are in no document, give no row; rows that repeat
an id are documents and items of their own; a null id comes before others of
its score; an empty table on either side gives no row; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casepipe.llm.common import flat, stored
from casepipe.llm.words import WordTable, word_pieces, words_of

BEST = 50
BLOCK_TERMS = 200_000
BLOCK_ITEMS = 10_000
#: Documents and term counts of a shard, about.
SHARD_DOCS = 1 << 14
SHARD_COUNTS = 1 << 21
NO_ID = -(1 << 63)


class Collection(NamedTuple):
    """Number of documents with a term, number of all their terms, and the terms' weights."""

    docs: int
    terms: int
    weight: np.ndarray

    def impact(self, term: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What ``count`` occurrences of ``term`` add to a document of ``size`` terms."""
        norm = 100 - 50 + (50 * size * self.docs) // max(1, self.terms)
        return self.weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * norm))


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Best:
    """The ``k`` best documents so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        if len(self.score) == self.k:  # full: scores below the last one have no chance
            some = score >= self.score[-1]
            score, doc = score[some], doc[some]
        if len(score):
            score, doc = np.append(self.score, score), np.append(self.doc, doc)
            order = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[order], doc[order]

    def above(self, bound: int) -> bool:
        """Whether no document of at most that score can enter."""
        return len(self.score) == self.k and bound < self.score[-1]


class Shard:
    """Impact lists of some documents."""

    def __init__(self, about: Collection, ids: np.ndarray, size: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray):
        """``ids`` and ``size`` by document; ``doc``, ``term`` and ``count`` by posting."""
        impact = about.impact(term, count, size[doc])
        some = impact > 0
        doc, term, impact = doc[some], term[some], impact[some]
        order = np.lexsort((-impact, term))
        self.ids = ids
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        #: Where each term's list begins; the last entry is the end.
        self.begin = np.searchsorted(term, np.arange(len(about.weight) + 1))
        # for direct access: (term, document) in order, and the place in the lists
        key = term * len(ids) + self.doc
        self.place = np.argsort(key)
        self.key = key[self.place]
        self.seen = np.zeros(len(key), bool)
        self.met = np.zeros(len(ids), bool)

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Add the shard's best documents for the terms; the number of documents scored."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        begin, end = self.begin[terms], self.begin[terms + 1]
        position, depth, step, met = begin.copy(), 0, best.k, []  # ``position``: after the best position
        while (position < end).any():
            docs = np.unique(np.concatenate([self.doc[b + depth : min(b + depth + step, e)] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]))
            docs = docs[~self.met[docs]]
            if len(docs):
                self.met[docs] = True
                met.append(docs)
                key = (terms[:, None] * len(self.ids) + docs).ravel()
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                there = self.key[at] == key
                place = self.place[at]
                best.add(np.where(there, self.impact[place], 0).reshape(len(terms), -1).sum(axis=0), self.ids[docs])
                self.seen[place[there]] = True
            bound = 0
            for i, (p, e) in enumerate(zip(position.tolist(), end.tolist(), strict=True)):
                while p < e:
                    run = self.seen[p : min(e, p + 4 * step)]
                    if not run.all():
                        p += int(run.argmin())
                        break
                    p += len(run)
                position[i] = p
                if p < e:
                    bound += int(self.impact[p - 1])
            if best.above(bound):
                break
            depth += step
            step = min(2 * step, 4096)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            self.seen[b:e] = False
        for docs in met:
            self.met[docs] = False
        return sum(map(len, met))


def term_counts(raw: np.ndarray, at: np.ndarray, table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its number of terms; and per (text, term of the table) of the
    texts the text, the term and its occurrences."""
    sizes, width = np.zeros(len(at) - 1, np.int64), max(1, len(table))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in word_pieces(raw, at):
        sizes += np.diff(np.searchsorted(begin, at))
        number = table.lookup(raw, begin, end)
        asked = number >= 0
        text = np.searchsorted(at, begin[asked], "right") - 1
        key, n = np.unique(text * width + number[asked], return_counts=True)
        keys.append(key)
        counts.append(n)
    # a text of several pieces has a term several times
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, back, np.concatenate(counts))
    return sizes, key // width, key % width, count


class _Items(NamedTuple):
    ids: list
    terms: list[np.ndarray]
    table: WordTable


def _item_blocks(items: DataFrame, block_terms: int) -> Iterator[_Items]:
    """Items with their terms' numbers, in blocks of bounded size."""
    ids, texts, known = [], [], {}

    def block() -> _Items:
        table = WordTable(known)
        return _Items(ids, [np.array(sorted({table.number[w] for w in t}), np.int64) for t in texts], table)

    for row in items.select(F.col("item_id").alias("i"), "text").toLocalIterator():
        own = set(words_of(row["text"]))
        if not own:
            continue
        if ids and (len(known) + len(own) > block_terms or len(ids) >= BLOCK_ITEMS):
            yield block()
            ids, texts, known = [], [], {}
        ids.append(row["i"])
        texts.append(own)
        known |= dict.fromkeys(own)
    if ids:
        yield block()


def _counted(docs: DataFrame, table: WordTable) -> DataFrame:
    """``(doc_id, size, terms, counts)`` of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, text, term, count = term_counts(*flat(b.column(1)), shared.value)
            off = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(t))) for x, t in ((term, np.int32), (count, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *lists], names=["doc_id", "size", "terms", "counts"]).filter(pa.array(size > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, size long, terms array<int>, counts array<long>")


def _shards(batches: Iterator[pa.RecordBatch], about: Collection) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []

    def shard() -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("doc_id").fill_null(NO_ID).to_numpy()
        lists = t.column("terms").combine_chunks(), t.column("counts").combine_chunks()
        term, count = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        doc = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
        return Shard(about, ids, t.column("size").to_numpy(), doc, term, count)

    docs = counts = 0
    for b in batches:
        held.append(b)
        docs, counts = docs + b.num_rows, counts + len(b.column("terms").flatten())
        if docs >= SHARD_DOCS or counts >= SHARD_COUNTS:
            yield shard()
            held, docs, counts = [], 0, 0
    if docs:
        yield shard()


def _block_results(docs: DataFrame, items: _Items, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each range for the items of a block."""
    spark = docs.sparkSession
    counted = stored(_counted(docs, items.table), "term-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    weights = np.zeros(len(items.table), np.int64)
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for term, n in holding.toLocalIterator():  # no more rows than the block has terms
        weights[term] = weight(n_docs, n)
    shared = spark.sparkContext.broadcast((Collection(n_docs, n_terms, weights), items.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, asked = shared.value
        best = [Best(k) for _ in asked]
        for shard in _shards(batches, about):
            for terms, own in zip(asked, best, strict=True):
                shard.search(terms, own)
        for i, own in enumerate(best):
            if len(own.score):
                ids = pa.array(own.doc, mask=own.doc == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), ids, pa.array(own.score)], names=["item", "doc_id", "score"])

    return counted.where(F.size("terms") > 0).select("doc_id", "size", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best of ``docs(doc_id, text)``
    for each of ``items(item_id, text)``, those of score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    for block in _item_blocks(items, block_terms):
        found = _block_results(docs, block, k)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
