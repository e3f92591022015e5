"""IOB reader and metrics (FIXTURES §1.5, §1.6)."""

import os

import random

import pytest
from pyspark.sql import functions as F

from casepipe.operators import metrics, profile
from casepipe.sources import iob

IOB = "-DOCSTART- -X- O O\n\nMr\tB-JUDGE\nSmith\tI-JUDGE\n\nsat\tO\n-DOCSTART- -X- O O\n-DOCSTART- -X- O O\n2020\t_\t_\tB-DATE\ntok\t\nx\tB-FOO\n"


@pytest.fixture()
def iob_path(scratch):
    p = os.path.join(scratch, "output-iob.tsv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(IOB)
    return p


def test_iob_documents(spark, iob_path):
    docs = iob.iob_documents(iob.read_lines(spark, iob_path)).orderBy("id").collect()
    assert [(d.id, d.tokens, d.ner_tags) for d in docs] == [
        ("0", ["Mr", "Smith", "sat"], [5, 6, 0]),
        ("1", ["2020", "tok", "x"], [3, 0, 0]),
    ]


def test_iob_tokens_and_entity_counts(spark, iob_path):
    toks = iob.iob_tokens(iob.read_lines(spark, iob_path)).orderBy("line_no")
    assert [(r.word, r.tag) for r in toks.collect()] == [("Mr", "B-JUDGE"), ("Smith", "I-JUDGE"), ("sat", "O"), ("x", "B-FOO")]
    counts = {r.entity: r["count"] for r in profile.entity_counts(toks).collect()}
    assert counts == {"JUDGE": 1, "FOO": 1}


def ner_tokens(spark):
    true = "B-JUDGE I-JUDGE O B-DATE O B-COURT".split()
    pred = "B-JUDGE I-JUDGE O O I-DATE B-LOCATION".split()
    return spark.createDataFrame([(0, i, t, p) for i, (t, p) in enumerate(zip(true, pred))], "doc_id INT, idx INT, true_tag STRING, pred_tag STRING")


def test_ner_metrics(spark):
    r = metrics.ner_metrics(ner_tokens(spark)).first()
    assert r.precision == pytest.approx(1 / 3)
    assert r.recall == pytest.approx(1 / 3)
    assert r.f1 == pytest.approx(1 / 3)
    assert r.accuracy == pytest.approx(0.5)
    assert r.auc_pr == pytest.approx(0.8333333, abs=1e-6)


def test_tag_report(spark):
    rep = {r["class"]: r for r in metrics.tag_report(ner_tokens(spark)).collect()}
    assert len(rep) == 11
    assert rep["B-JUDGE"].precision == 1.0 and rep["B-JUDGE"].support == 1
    assert rep["O"].precision == 0.5 and rep["O"].recall == 0.5
    assert rep["B-DATE"].recall == 0.0 and rep["B-DATE"].precision == 0.0


def test_multilabel_metrics(spark):
    rows = [([1, 0], [2.0, -2.0]), ([0, 1], [-0.5, 0.0]), ([1, 0], [-3.0, -0.9]), ([0, 1], [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "y ARRAY<INT>, logits ARRAY<DOUBLE>")
    r = metrics.multilabel_metrics(df).first()
    assert r.f1 == pytest.approx(0.583333, abs=1e-6)
    assert r.roc_auc == pytest.approx(0.625)
    assert r.hamming_loss == pytest.approx(0.375)


def entities(tags):
    """(type, start, end) of every entity, by a plain loop."""
    out = []
    for i, tag in enumerate(tags):
        prev = tags[i - 1] if i else "O"
        if tag == "O":
            continue
        kind = tag.rsplit("-", 1)[-1]
        if tag.startswith("B-") or prev == "O" or prev.rsplit("-", 1)[-1] != kind:
            out.append([kind, i, i])
        else:
            out[-1][2] = i
    return {tuple(e) for e in out}


def test_chunk_rules():
    # I- after O starts a chunk; type change starts a chunk
    tags = "I-DATE I-DATE O I-JUDGE B-JUDGE I-COURT".split()
    assert entities(tags) == {("COURT", 5, 5), ("DATE", 0, 1), ("JUDGE", 3, 3), ("JUDGE", 4, 4)}


@pytest.mark.parametrize("block_rows", [1, 2, 3, 5, 4096])
def test_entities_over_block_edges(spark, block_rows):
    """Counts equal the plain loop's, whatever the blocks; positions may have gaps; a document may have no id."""
    rng = random.Random(block_rows)
    rows, want = [], [0, 0, 0]
    for doc in [*range(40), None]:
        n = rng.randrange(1, 30)
        vocabulary = rng.choice([["O", "I-A"], ["O", "B-A", "I-A", "I-A", "I-A"], ["O", "B-A", "I-A", "I-B", "B-B"]])
        true = [rng.choice(vocabulary) for _ in range(n)]
        pred = [t if rng.random() < 0.8 else rng.choice(vocabulary) for t in true]
        t, p = entities(true), entities(pred)
        want = [want[0] + len(t), want[1] + len(p), want[2] + len(t & p)]
        at = sorted(rng.sample(range(2 * n), n))
        rows += [(doc, i, x, None if y == "O" and rng.random() < 0.1 else y) for i, x, y in zip(at, true, pred)]
    df = spark.createDataFrame(rows, "doc_id INT, idx INT, true_tag STRING, pred_tag STRING")
    r = metrics._ner_counts(df, "doc_id", "idx", block_rows).first()
    assert [r.n_true, r.n_pred, r.tp] == want
    known = [(x, y) for _, _, x, y in rows if y is not None]
    assert r.n == len(known) and r.accuracy == pytest.approx(sum(x == y for x, y in known) / len(known))


def test_entities_of_no_tokens(spark):
    r = metrics.ner_metrics(spark.createDataFrame([], "doc_id INT, idx INT, true_tag STRING, pred_tag STRING")).first()
    assert (r.precision, r.recall, r.accuracy) == (0.0, 0.0, None)
