"""Decontamination and language identification."""

import random

import brute
import numpy as np
from casepipe.llm import automaton, ecoc
from pyspark.sql import functions as F


def marked(docs, items, **k):
    return {(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids))) for r in automaton.contamination(docs, items, **k).collect()}


def expected(docs, items):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bench = [(r.item_id, r.text) for r in items.collect()]
    return {(i, *x) for (i, _), x in zip(rows, brute.contaminated(rows, bench), strict=True)}


def planted(spark):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(None, None), (3, "a B, c"), (90, text(12))]
    docs = []
    for i in range(60):
        words = [text(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            t = (rng.choice(items)[1] or "").split()
            lo = rng.randint(0, max(0, len(t) - 10))
            words += [" ".join(t[lo : lo + rng.randint(1, 14)]).upper(), text(rng.randint(0, 5))]
        docs.append((i, ", ".join(words)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_automaton_against_plain_windows(shipped):
    docs, items = planted(shipped)
    assert marked(docs, items) == expected(docs, items)


def test_blocks_of_items_give_the_same(shipped):
    docs, items = planted(shipped)
    assert marked(docs, items, block_words=60) == expected(docs, items)
    spans = [{r.doc_id: r.spans for r in automaton.contamination(docs, items, block_words=n).collect()} for n in (60, 200_000)]
    assert spans[0] == spans[1]
    texts = [{r.doc_id: r.text for r in automaton.decontaminate(docs, items, block_words=n).collect()} for n in (60, 200_000)]
    assert texts[0] == texts[1] and len(texts[0]) < docs.count()


def test_alike_words_are_told_apart(shipped):
    """Words that any polynomial hash modulo a power of two takes for one."""
    docs, items = [], []
    for i, n in enumerate((9, 10, 12)):
        morse = "a"
        for _ in range(n):
            morse += morse.translate(str.maketrans("ab", "ba"))
        docs.append((i, f"x {morse} y"))
        items.append((i, morse.translate(str.maketrans("ab", "ba"))))
    docs.append((9, f"x {items[0][1].upper()} y"))
    d = shipped.createDataFrame(docs, "doc_id long, text string")
    b = shipped.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in automaton.contamination(d, b).collect()} == {0: 0, 1: 0, 2: 0, 9: 1}


def test_long_text_in_pieces(shipped, monkeypatch):
    item = " ".join(f"q{i}" for i in range(12))
    text = "filler words " * 60_000 + item + " more" * 100_000
    d = shipped.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    b = shipped.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, [tuple(s) for s in r.spans]) for r in automaton.contamination(d, b).collect()}
    at = text.index("q0")
    assert got == {1: (220_012, 12, [(at, at + len(item))]), 2: (1, 0, [])}


def test_clashing_columns_stay(shipped):
    item = " ".join(f"q{i}" for i in range(12))
    row = (1, f"a b c d e f g h i j k l m {item}", 2, "w", True, {"k": 1}, 3)
    docs = shipped.createDataFrame([row], "doc_id long, text string, row int, spans string, no_text boolean, items map<string,int>, n_words int")
    items = shipped.createDataFrame([(1, item), (2, item + " z")], "item_id long, text string")
    for n in (5, 200_000):
        out = automaton.decontaminate(docs, items, block_words=n)
        assert out.columns == docs.columns and tuple(out.first()) == (1, "a b c d e f g h i j k l m ", *row[2:])


def test_odd_rows(odd_docs, no_docs, benchmark):
    assert marked(odd_docs, benchmark) == expected(odd_docs, benchmark)
    assert marked(no_docs, benchmark) == set()
    assert all(r[2] == 0 for r in marked(odd_docs, benchmark.where("false")))


def test_decontaminate_removes_spans_only(shipped):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"clean start, {item.upper()}! clean end " + "x y z " * 10, 7), (2, item, 7), (3, None, 7), (4, "clean", 7)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, _spans int")
    items = shipped.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in automaton.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "clean start, ! clean end " + "x y z " * 10 and got[3].text is None and got[1]._spans == 7


def test_codewords_differ():
    for k in (2, 3, 4, 6, 7, 40):
        c = ecoc.codewords(k)
        least = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
        assert least >= 1 and (k < 7 or least >= c.shape[1] // 5)
        assert (c.any(axis=0) & ~c.all(axis=0)).all()


def test_held_out_accuracy(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = ecoc.learn(docs.select("doc_id", "text", "lang"))
    got = ecoc.identify(docs.where(ecoc.held_out()), model).where("lang IS NOT NULL")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.97 * n


def test_odd_rows_language(odd_docs, no_docs, shipped):
    model = ecoc.learn(odd_docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in ecoc.identify(odd_docs, model).collect()}
    assert got[0] == got[1] == got[2] == got[6] == ("und", 0.0)
    assert got[5] == ("en", 1.0)
    none = ecoc.learn(no_docs.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in ecoc.identify(odd_docs, none).collect()} == {"und"}
    assert ecoc.identify(no_docs, model).count() == 0


def test_decoding_corrects_a_wrong_bit():
    model = ecoc.LanguageModel({x: np.eye(4, 1 << ecoc.SIZE_BITS)[i] for i, x in enumerate("abcd")})
    sign = np.where(model.code, 1.0, -1.0)
    for i in range(4):
        for j in range(model.code.shape[1]):
            m = sign[i].copy()
            m[j] *= -1
            best, score, _ = model.decode(m[None])
            assert best[0] == i and 0 <= score[0] <= 1
