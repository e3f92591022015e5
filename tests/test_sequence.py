"""Sequence tagger against a plain dynamic program."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from casepipe.functions.tags import TAG_IDS, TAGS
from casepipe.operators import sequence


def plain(scores, transitions):
    """Best score and path of one document, token by token."""
    delta, back = transitions[-1] + scores[0], []
    for s in scores[1:]:
        step = delta[:, None] + transitions[:-1]
        back.append(step.argmax(axis=0))
        delta = step.max(axis=0) + s
    path = [int(delta.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return delta.max(), path[::-1]


def value(path, scores, transitions):
    return sum(transitions[b, t] + s[t] for b, t, s in zip([-1, *path], path, scores))


def tokens(spark, documents):
    rows = [(d, i, [float(x) for x in s]) for d, scores in documents.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "doc_id long, idx int, scores array<double>")


def test_paths_equal_the_plain_program(spark):
    rng = np.random.default_rng(5)
    transitions = sequence.transition_scores({(0, 0): 50, (None, 1): 3, (1, 2): 9, (2, 2): 4, (2, 0): 2})
    documents = {d: rng.integers(-9000, 0, (n, len(TAGS))).astype(float) for d, n in enumerate([1, 2, 3, 4, 17, 90])}
    for size in (3, 4096):  # three: four levels of blocks
        got = {}
        for r in sequence.best_paths(tokens(spark, documents), transitions, block_rows=size).orderBy("idx").collect():
            got.setdefault(r.doc_id, []).append(r.tag)
        assert got == {d: plain(s, transitions)[1] for d, s in documents.items()}


def test_ties_across_blocks_stay_optimal(spark):
    transitions = sequence.transition_scores({})
    documents = {1: np.zeros((50, len(TAGS)))}
    for size in (4, 4096):
        path = [r.tag for r in sequence.best_paths(tokens(spark, documents), transitions, block_rows=size).orderBy("idx").collect()]
        assert value(path, documents[1], transitions) == plain(documents[1], transitions)[0]
    assert path == plain(documents[1], transitions)[1]


def test_no_tokens(spark):
    assert sequence.best_paths(tokens(spark, {1: []}), sequence.transition_scores({})).count() == 0


def test_tagger_counts_and_tags_are_valid(spark):
    rng = np.random.default_rng(3)
    kinds = ["O", "B-CITATION", "I-CITATION", "B-DATE", "I-DATE"]
    rows = []
    for d in range(24):
        tag = "O"
        for i in range(40):
            tag = str(rng.choice([t for t in kinds if sequence.allowed(tag if i else None, t)]))
            word = None if rng.random() < 0.03 else tag[-4:] + str(rng.integers(0, 3)) if rng.random() < 0.6 else "noise"
            rows.append((d, i, word, "I-DATE" if d == 0 and i == 0 else tag, "train" if d < 16 else "test"))
    df = spark.createDataFrame(rows, "doc_id long, idx int, word string, true_tag string, split string")
    got = {(r.doc_id, r.idx): r.pred_tag for r in sequence.tag_sequences(df, block_rows=16).collect()}
    train = [r for r in rows if r[4] == "train"]
    by_tag = Counter(TAG_IDS[r[3]] for r in train)
    feature = {"w": lambda w: w.lower(), "x": lambda w: w.lower()[-3:]}
    counts = {n: Counter((g(r[2]), TAG_IDS[r[3]]) for r in train if r[2] is not None) for n, g in feature.items()}
    sizes = {n: len({w for w, _ in c}) for n, c in counts.items()}
    follows = Counter((TAG_IDS[train[j - 1][3]] if r[1] else None, TAG_IDS[r[3]]) for j, r in enumerate(train))
    transitions = sequence.transition_scores(follows)
    for d in range(16, 24):
        words = [r[2] for r in rows if r[0] == d]
        scores = np.array([[math.floor(1000 * sum(math.log(((counts[n][(g(w), t)] if w is not None else 0) + 1) / (by_tag[t] + sizes[n] + 1)) for n, g in feature.items())) for t in range(len(TAGS))] for w in words], float)
        path = [TAG_IDS[got[(d, i)]] for i in range(len(words))]
        assert value(path, scores, transitions) == plain(scores, transitions)[0]
        assert all(sequence.allowed(TAGS[b] if b is not None else None, TAGS[t]) for b, t in zip([None, *path], path))
    assert len(got) == 8 * 40
    assert sequence.tag_sequences(df.withColumn("split", F.lit("test")).limit(5)).count() == 5  # nothing learned
