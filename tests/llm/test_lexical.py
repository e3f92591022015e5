"""Ranked search against scoring every document."""

import math
import random
from collections import Counter

import brute
import numpy as np

from casepipe.llm import lexical


def terms(text):
    return brute.ITEM_WORD.findall((text or "").translate(brute.LOW))


def expected(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(spark, seed, n_docs, n_items):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "Ab", "x" * 30]
    text = lambda n: rng.choice([" ", ", "]).join(vocabulary[min(int(rng.expovariate(0.05)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(rng.choice([i, i, i // 2, None]), rng.choice([None, ""]) if i % 17 == 0 else text(rng.randint(1, 60))) for i in range(n_docs)]
    docs += [(5000 + i, "tie tie w3") for i in range(90)]
    items = [(i, text(rng.randint(0, 12))) for i in range(n_items)] + [(None, "W3 tie"), (0, "w1 w1"), (900, None), (901, "nowhere")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_every_document(shipped):
    docs, items, d, i = made(shipped, 1, 500, 25)
    assert rows(lexical.search(d, i)) == expected(docs, items)


def test_blocks_of_items_and_small_k(shipped):
    docs, items, d, i = made(shipped, 2, 200, 20)
    assert rows(lexical.search(d, i, k=3, block_terms=15)) == expected(docs, items, 3)


def test_shards_stop_early_and_agree():
    rng = np.random.default_rng(3)
    n, width = 4000, 40
    per = 12
    doc = np.repeat(np.arange(n), per)
    term = np.concatenate([rng.choice(width, per, replace=False) for _ in range(n)])
    count = rng.zipf(1.6, len(doc)).clip(1, 500)
    size = np.bincount(doc, count, n).astype(np.int64) + rng.integers(0, 200, n)
    weight = np.array([lexical.weight(n, h) for h in np.bincount(term, minlength=width)])
    about = lexical.Collection(n, int(size.sum()), weight)
    ids = rng.permutation(n)
    asked = [rng.choice(width, m, replace=False) for m in (1, 2, 5, 10)]
    impact = about.impact(term, count, size[doc])
    shards = [lexical.Shard(about, ids[lo : lo + 1000], size[lo : lo + 1000], doc[own] - lo, term[own], count[own]) for lo in range(0, n, 1000) for own in [slice(lo * per, (lo + 1000) * per)]]
    for terms_ in asked:
        best = lexical.Best(20)
        scored = sum(s.search(terms_, best) for s in shards)
        total = np.bincount(doc, np.where(np.isin(term, terms_), impact, 0), n).astype(np.int64)
        order = np.lexsort((ids, -total))[:20]
        assert best.score.tolist() == total[order].tolist() and best.doc.tolist() == ids[order].tolist()
        assert scored < n
        assert not any(s.seen.any() or s.met.any() for s in shards)
    assert scored < (total > 0).sum()


def test_equal_scores_are_not_cut_by_the_bound(shipped):
    docs = [(i, "a b") for i in range(300, 0, -1)]
    d = shipped.createDataFrame(docs + [(1000 + i, "c") for i in range(400)], "doc_id long, text string").repartition(3)
    i = shipped.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.doc_id for r in lexical.search(d, i).orderBy("rank").collect()] == list(range(1, 51))


def test_odd_rows(odd_docs, no_docs, benchmark, shipped):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = shipped.createDataFrame([(1, "a orphan w7"), (1, "a"), (2, ""), (3, None), (None, "中文 é 's")], "item_id int, text string").selectExpr("*", "1 AS item", "2 AS rank")
    assert rows(lexical.search(odd_docs, items)) == expected(docs, [(r.item_id, r.text) for r in items.collect()])
    assert rows(lexical.search(no_docs, benchmark)) == [] and rows(lexical.search(odd_docs, items.where("false"))) == []


def test_counts_of_long_texts(monkeypatch):
    from casepipe.llm import words

    texts = ["a b a", "", "b " * 500 + "a" * 400 + " c"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    table = words.WordTable([b"a", b"b"])
    monkeypatch.setattr(lexical, "word_pieces", lambda r, a: words.word_pieces(r, a, 16))
    size, text, term, count = lexical.term_counts(raw, at, table)
    assert size.tolist() == [3, 0, 502]
    assert list(zip(text.tolist(), term.tolist(), count.tolist(), strict=True)) == [(0, 0, 2), (0, 1, 1), (2, 1, 500)]
