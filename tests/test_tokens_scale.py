"""Token queries at size: features inside a document's row, tag paths of many documents at once, slim entity counts."""

import numpy as np
from pyspark.sql import functions as F

from casepipe.functions.tags import TAGS
from casepipe.operators import models, sequence
from casepipe.plans import adapters as A
from casepipe.session import ship
from tests.test_sequence import plain


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, words array<string>, split string")


def exploded(docs):
    return docs.select("doc_id", F.posexplode("words").alias("idx", "word"), "split")


FEATURES = ["doc_id", "idx", "word", "prev_word", "next_word", "shape", "suffix"]


def test_features_of_a_document_need_no_shuffle(spark):
    docs = documents(spark, [(i, [f"Wé{i}", "x", f"{i}9"][: i % 4], "train") for i in range(20)])
    got = models.document_features(docs)
    assert "Exchange" not in plan_of(got)
    want = models.token_features(exploded(docs).select("doc_id", "idx", "word"))
    assert sorted(map(str, got.select(FEATURES).collect())) == sorted(map(str, want.select(FEATURES).collect()))


def test_features_of_repeated_and_null_keys(spark, monkeypatch):
    docs = documents(spark, [(1, ["a", "b"], "train"), (1, ["a", "b"], "train"), (2, ["C"], "test"), (None, ["d"], "test"), (3, None, "test"), (4, [], "test")])
    t = exploded(docs).withColumn("n", F.length("word"))
    want = models.token_features(t.select("doc_id", "idx", "word")).join(t.select("doc_id", "idx", "split", "n"), ["doc_id", "idx"])
    want = sorted(map(str, want.select(*FEATURES, "split", "n").collect()))
    assert len(want) == 9  # of two tokens at one place, each meets both rows
    for limit in (models.BROADCAST_KEYS, 0):
        monkeypatch.setattr(models, "BROADCAST_KEYS", limit)
        got = models.document_features(docs, further={"n": F.length("word")})
        assert sorted(map(str, got.select(*FEATURES, "split", "n").collect())) == want


def test_tagger_takes_ready_features(spark):
    rng = np.random.default_rng(1)
    parts = ["train"] * 8 + ["validation"] * 2 + ["test"] * 2
    docs = documents(spark, [(d, [f"w{x}" for x in rng.integers(0, 6, 30)], p) for d, p in enumerate(parts)])
    tags = {"true_tag": A.true_tag_of(F.col("word"), F.col("idx"))}
    ready = models.document_features(docs, further=tags)
    plain_ = exploded(docs).withColumn("true_tag", tags["true_tag"])
    got, want = (sorted(map(str, models.fit_tagger(t, num_features=64, reg_grid=(0.01,)).select("doc_id", "idx", "true_tag", "pred_tag").collect())) for t in (ready, plain_))
    assert len(got) == 60 and got == want


def test_many_runs_at_once_equal_the_plain_program():
    rng = np.random.default_rng(7)
    transitions = sequence.transition_scores({(0, 0): 50, (None, 1): 3, (1, 2): 9, (2, 2): 4, (2, 0): 2})
    runs = [rng.integers(-40, 0, (n, len(TAGS))).astype(float) for n in (3, 1, 70, 70, 2, 18)]
    starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
    entry = np.tile(np.append(np.full(len(TAGS), -np.inf), 0.0), (len(runs), 1))
    got = sequence.tag_runs(np.concatenate(runs), starts, entry, np.full(len(runs), -1), transitions)
    assert got.tolist() == [t for r in runs for t in plain(r, transitions)[1]]


def test_runs_pass_batch_edges_and_keep_columns(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(8)
    transitions = sequence.transition_scores({})
    docs = {d: rng.integers(-9000, 0, (n, len(TAGS))).astype(float) for d, n in enumerate([40, 1, 7, 300, 12])}
    rows = [(d, i, [float(x) for x in s], f"{d}/{i}") for d, v in docs.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, scores array<double>, k string")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    monkeypatch.setattr(sequence, "RUN_ROWS", 16)
    try:
        for size in (64, 4096):
            got = sequence.best_paths(df, transitions, block_rows=size, keep=["k"]).collect()
            assert sorted((r.doc_id, r.idx, r.k) for r in got) == sorted((d, i, k) for d, i, _, k in rows)
            for d, v in docs.items():
                assert [r.tag for r in sorted(got, key=lambda r: r.idx) if r.doc_id == d] == plain(v, transitions)[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_a_place_given_twice_gets_each_tag(spark):
    rows = [(1, 0, [1.0] * 11, "a"), (1, 0, [1.0] * 11, "b"), (1, 1, [1.0] * 11, "c")]
    df = spark.createDataFrame(rows, "doc_id long, idx int, scores array<double>, k string")
    got = sequence.best_paths(df, sequence.transition_scores({}), keep=["k"]).collect()
    assert sorted((r.idx, r.k) for r in got) == [(0, "a"), (0, "a"), (0, "b"), (0, "b"), (1, "c")]


def test_a_words_digests_are_made_once(spark, scratch):
    spark.createDataFrame([(1, "one fourteen Cé")], "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    pieces = A.ner_pieces(spark, scratch)
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2
    assert [r.idx for r in pieces.orderBy("idx").collect()] == [0, 1, 2, 3]
