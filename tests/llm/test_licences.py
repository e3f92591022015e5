"""Licence scans against regular expressions over the words."""

import random
import re

import brute
import numpy as np
import pytest

from casepipe.llm import licences, words
from casepipe.llm.queries import _licence_sql


def regex(r):
    if r.kind == "word":
        return r.word + " "
    if r.kind == "any":
        return f"(?:[^ ]+ ){{{r.low},{r.high}}}"
    return "".join(map(regex, r.parts)) if r.kind == "all" else f"(?:{'|'.join(map(regex, r.parts))})"


def plain(text, templates):
    """``{(template, first word, words)}`` of the longest stretch from each word."""
    w = brute.ITEM_WORD.findall((text or "").translate(brute.LOW))
    out = set()
    for k, t in enumerate(templates):
        p = re.compile(regex(licences.parse(t.markup)))
        for i in range(len(w)):
            for j in range(len(w), i, -1):
                if p.fullmatch("".join(x + " " for x in w[i:j])):
                    out.add((k, i, j - i))
                    break
    return len(w), out


def found(spark, texts, templates):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, {(m.template, m.first_word, m.n_words) for m in r.matches}) for r in licences.scan_licences(rows, templates).collect()}
    return [got[i] for i in range(len(texts))]


def test_random_templates(shipped):
    rng = random.Random(5)
    templates = [licences.Template(f"t{i}", m) for i, m in enumerate(["a b", "a [b] c", "a {0-2} c", "(a b|b) [c {1-2}] a", "c [a [b]] {1-1}", "b (a|c) (a|[b] c)", "a a", "c"])]
    texts = [" ".join(rng.choice("aAbc d".split() + ["é", "x-a"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert found(shipped, texts, templates) == [plain(t, templates) for t in texts]


def test_states_may_start_afresh(shipped, monkeypatch):
    auto = licences.TemplateAutomaton()
    text = "the licence: released under the terms of the MIT license, cc by-nc 4.0"
    raw = np.frombuffer(text.encode(), np.uint8)
    numbers, first = auto.words.numbers(raw, np.array([0, len(raw)]))
    whole = list(auto.matches(numbers, first))
    monkeypatch.setattr(licences, "STATES", 3)
    assert whole == list(auto.matches(numbers, first)) and {licences.TEMPLATES[k].label for _, _, f in whole for k in f} == {"mit", "cc-by-nc-4.0"}


def test_wording_with_its_variants(shipped):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this {0} and associated documentation files (the \"{0}\"), to deal in the {0} without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the {0}, and to permit persons to whom the {0} is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the {0}."
    texts = [grant.format("Software"), grant.format("font software"), grant.replace("hereby ", ""), "GNU Lesser General Public License", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: ISC"]
    rows = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {m.label for m in r.matches} for r in licences.scan_licences(rows).collect()}
    assert got == {0: {"mit-text"}, 1: {"mit-text"}, 2: set(), 3: {"gpl", "lgpl"}, 4: {"apache", "apache-2.0"}, 5: {"spdx-tag"}}


@pytest.mark.parametrize("markup", ["a [b", "a b]", "{1-2} a", "[a] {1-2} b", "[a]", "", "a (b", "a | b"])
def test_faulty_markup_is_refused(markup):
    with pytest.raises(ValueError):
        licences.TemplateAutomaton([licences.Template("x", markup)])


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((str(r.doc_id), r.n_words, len(r.matches)) for r in licences.scan_licences(odd_docs).collect())
    assert got == sorted((str(i), len(brute.ITEM_WORD.findall((t or "").translate(brute.LOW))), 0) for i, t in rows)
    assert licences.scan_licences(no_docs).count() == 0
    assert "mit license " in _licence_sql()


def test_word_table_on_odd_words():
    rng = random.Random(9)
    letters = "aB9é中"
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(400)]
    texts = [" ,\n".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "x" * 5000]
    low = [[w.encode() for w in brute.ITEM_WORD.findall(t.translate(brute.LOW))] for t in texts]
    known = [w.translate(brute.LOW).encode() for w in pool[:200]]
    table = words.WordTable(known)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for size in (1, 64, 1 << 20):
        pieces = [(b, e) for b, e in words.word_pieces(raw, at, size)]
        begin, end = (np.concatenate(x) for x in zip(*pieces, strict=True))
        assert [words.words_of(raw[b:e].tobytes().decode())[0] for b, e in zip(begin, end, strict=True)] == [w for t in low for w in t]
    got, first = table.numbers(raw, at)
    assert got.tolist() == [table.number.get(w, -1) for t in low for w in t]
    assert np.diff(first).tolist() == [len(t) for t in low]
    assert (words.WordTable([]).numbers(raw, at)[0] == -1).all()
