"""Repeat finders against plain versions."""

import random

import brute
import numpy as np
import pytest
from casepipe.llm import common, debruijn, lshforest, radix
from casepipe.llm.common import sliding_min


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def removed_bytes(df, **k):
    return {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix.remove_repeats(df, **k).collect()}


def removed_words(df, **k):
    return {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_copied(df, **k).collect()}


def passages(shipped, n, unit):
    """Documents that share passages of many lengths around the threshold, some inside one document."""
    rng = random.Random(n)
    shared = [[f"{unit}{rng.randrange(9999)}" for _ in range(rng.randint(20, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
            p = rng.choice(shared)
            lo = rng.randint(0, 8)
            words += p[lo : len(p) - rng.randint(0, 8)]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    rows.append((n, "ab" * 400))  # a period: every window starts in many places
    rows.append((n + 1, "z " * 300))
    return shipped.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("limit", [1000, 1])
def test_bytes(shipped, limit):
    df = passages(shipped, 40, "p")
    rows = rows_of(df)
    want = {(i, *x) for (i, _), x in zip(rows, brute.repeated_bytes(rows), strict=True)}
    assert removed_bytes(df, group_limit=limit) == want


@pytest.mark.parametrize("limit", [1000, 1])
def test_words(shipped, limit):
    df = passages(shipped, 40, "q")
    rows = rows_of(df)
    want = {(i, *x) for (i, _), x in zip(rows, brute.copied_words(rows), strict=True)}
    assert removed_words(df, group_limit=limit) == want


def test_ids_that_repeat_or_lack(shipped):
    """Rows of one id, or of none, are judged each on its own text."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    shared, other, third = words("s", 120), words("q", 90), words("c", 95)
    rows = [(1, shared), (None, shared), (None, third), (5, shared), (5, other), (5, other), (None, third + " end"), (7, other + " x"), (6, None)]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (str(x[0]), *x[1:])
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.copied_words(rows), strict=True)), key=key)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_copied(df).collect()]
    assert sorted(got, key=key) == want
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.repeated_bytes(rows), strict=True)), key=key)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix.remove_repeats(df).collect()]
    assert sorted(got, key=key) == want


def morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_alike_words_are_told_apart(shipped):
    """Words that every polynomial hash modulo a power of two takes for one."""
    for n in (9, 10, 12):
        x, y = morse(n)
        rest = [f"w{i}" for i in range(60)]
        rows = [(1, " ".join([*rest[:30], x, *rest[30:]])), (2, " ".join([*rest[:30], y, *rest[30:]])), (3, " ".join([*rest[:30], y, *rest[30:], "z"]))]
        df = shipped.createDataFrame(rows, "doc_id long, text string")
        assert removed_words(df) == {(i, *x) for (i, _), x in zip(rows, brute.copied_words(rows), strict=True)}
        short = [(1, " ".join([x, *rest[:9]])), (2, " ".join([y, *rest[:9]])), (3, f"{x} b"), (4, f"{y} b")]
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in lshforest.near_dedup(shipped.createDataFrame(short, "doc_id long, text string")).collect()}
        assert got == {(i, *x[:2]) for (i, _), x in zip(short, brute.near_components(short), strict=True)}
        sets = [lshforest.shingle_sets(raw, np.array([0, len(raw)]), common.Rolling(4), common.Rolling(5))[0] for raw in (np.frombuffer(t.encode(), np.uint8) for _, t in short)]
        assert not set(sets[2].tolist()) & set(sets[3].tolist()) and len(set(sets[0].tolist()) ^ set(sets[1].tolist())) == 2


def test_sample(sample_docs):
    rows = rows_of(sample_docs)
    assert removed_bytes(sample_docs) == {(i, *x) for (i, _), x in zip(rows, brute.repeated_bytes(rows), strict=True)}
    assert removed_words(sample_docs) == {(i, *x) for (i, _), x in zip(rows, brute.copied_words(rows), strict=True)}


def test_odd_rows(odd_docs, no_docs):
    rows = rows_of(odd_docs)
    assert removed_words(odd_docs) == {(i, *x) for (i, _), x in zip(rows, brute.copied_words(rows), strict=True)}
    got = {r[0]: r for r in removed_bytes(odd_docs)}
    long = len(dict(rows)[9].encode())
    assert got[9][1:4] == (long, long, 1) and got[0][1:4] == (0, 0, 0) and got[None][1:4] == (11, 0, 0)
    assert removed_bytes(no_docs) == removed_words(no_docs) == set()


def test_kept_text(shipped):
    rows = [(1, "x" * 10 + "".join(chr(97 + i % 26) + str(i) for i in range(120))), (2, "".join(chr(97 + i % 26) + str(i) for i in range(120)) + "yy")]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept for r in radix.remove_repeats(df, keep_text=True).collect()} == {1: bytearray(b"x" * 10), 2: bytearray(b"yy")}


def test_long_text_in_pieces(shipped, monkeypatch):
    # pieces of a long text must give the windows that one pass gives
    from casepipe.llm import repeats

    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    raw = np.frombuffer(text.encode(), np.uint8)
    for scheme in (repeats.Scheme(200, 50, False), repeats.Scheme(50, 12, True)):
        found = []
        for slab in (1 << 20, 1 << 12):
            monkeypatch.setattr(repeats, "SLAB", slab)
            windows = set()
            hashes = repeats.Rolling(1), repeats.Rolling(2)
            for before, a, b, own in repeats._parts(scheme, raw, np.array([0, len(raw)]), hashes):
                s = repeats.segments(a, b, own, scheme.length, scheme.k, *hashes)
                for lo, hi, g in zip(s.lo + before, s.hi + before, s.gram, strict=True):
                    windows |= {(x, int(g)) for x in range(lo, hi + 1)}
            found.append(windows)
        assert found[0] == found[1]


def test_sliding_min():
    rng = np.random.default_rng(1)
    for n, w in ((1, 1), (5, 3), (100, 7), (64, 64), (3, 4)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(n - w + 1)]
