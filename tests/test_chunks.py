"""Labelling whose finished chunks outlive a crash."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from casepipe.operators import labelling
from casepipe.session import ship


def answering(word):
    def fn(texts):
        return [f"{word} {t}" for t in texts]

    return fn


@pytest.fixture()
def todo(spark):
    ship(spark)
    return spark.createDataFrame([(i, f"text {i}") for i in range(60)], "id INT, t STRING")


def killed(todo, root, word):
    with pytest.raises(Exception):
        labelling.label_in_chunks(todo, root, "t", ["id"], labelling.killed_on(word, answering("first")), chunk_rows=10)


def test_a_killed_run_keeps_its_chunks(spark, todo, scratch):
    root = os.path.join(scratch, "out")
    chunk = {r.id: r.c for r in todo.select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("c")).collect()}
    victim = next(i for i, c in chunk.items() if c == 3)
    killed(todo, root, f"text {victim}")
    log = labelling.CommitLog(spark, root).entries()
    assert sorted(e.chunk for e in log) == [-1, 0, 1, 2]
    got = {r.id: r.output for r in labelling.label_in_chunks(todo, root, "t", ["id"], answering("second"), chunk_rows=10).collect()}
    assert got == {i: f"{'first' if chunk[i] < 3 else 'second'} text {i}" for i in range(60)}
    again = labelling.label_in_chunks(todo, root, "t", ["id"], answering("third"), chunk_rows=10)
    assert {r.id: r.output for r in again.collect()} == got


def test_a_crash_before_the_ledger_repeats_the_chunk(spark, todo, scratch, monkeypatch):
    root = os.path.join(scratch, "out")
    commit = labelling.CommitLog.commit

    def crashing(self, round_, chunk, n):
        if chunk == 2:
            raise RuntimeError("driver lost")
        commit(self, round_, chunk, n)

    monkeypatch.setattr(labelling.CommitLog, "commit", crashing)
    with pytest.raises(RuntimeError):
        labelling.label_in_chunks(todo, root, "t", ["id"], answering("first"), chunk_rows=10)
    monkeypatch.setattr(labelling.CommitLog, "commit", commit)
    out = labelling.label_in_chunks(todo, root, "t", ["id"], answering("second"), chunk_rows=10)
    assert out.count() == 60 and out.select("id").distinct().count() == 60
    words = {r.w: r.n for r in out.groupBy(F.split("output", " ")[0].alias("w")).agg(F.count("*").alias("n")).collect()}
    assert set(words) == {"first", "second"}


def test_a_crash_before_the_round_starts_deals_anew(spark, todo, scratch):
    root = os.path.join(scratch, "out")
    todo.limit(5).withColumn("chunk", F.lit(0)).write.partitionBy("chunk").parquet(f"{root}/round=0/todo")  # no ledger row
    assert labelling.label_in_chunks(todo, root, "t", ["id"], answering("x"), chunk_rows=25).count() == 60


def test_failed_and_new_rows_make_the_next_round(spark, todo, scratch):
    root = os.path.join(scratch, "out")
    first = labelling.label_in_chunks(todo.where("id < 40"), root, "t", ["id"], labelling.failing_on("7", answering("a")), batch_size=1, chunk_rows=15)
    assert first.count() == 40 and first.where("error IS NOT NULL").count() == 4
    second = labelling.label_in_chunks(todo, root, "t", ["id"], answering("b"), chunk_rows=15)
    got = {r.id: r.output for r in second.collect()}
    assert got == {i: f"{'a' if i < 40 and '7' not in str(i) else 'b'} text {i}" for i in range(60)}
    rounds = [e for e in labelling.CommitLog(spark, root).entries() if e.chunk < 0]
    assert len(rounds) == 2


def test_nothing_to_do(todo, scratch):
    out = labelling.label_in_chunks(todo.where("false"), os.path.join(scratch, "out"), "t", ["id"], answering("x"))
    assert out.columns == ["id", "output", "error"] and out.count() == 0


def test_the_stand_in_rule_is_linear():
    import time

    t0 = time.time()
    assert labelling.rule_labeller(["Act" + " " * 300_000 + "x", "s.12 of", None, "Act 1990", "nothing"]) == ["0", "1", None, "1", "0"]
    assert time.time() - t0 < 5


def test_partitions_bound_the_calls_at_one_time(spark, scratch):
    def counting(texts):
        mine = os.path.join(scratch, uuid.uuid4().hex)
        open(mine, "w").close()
        time.sleep(0.02)
        n = len(os.listdir(scratch))
        os.remove(mine)
        return [str(n)] * len(texts)

    df = spark.range(400).select("id", F.col("id").cast("string").alias("t")).repartition(8)
    got = [int(r.output) for r in labelling.batch_label(df, "t", ["id"], counting, batch_size=10, partitions=2).collect()]
    assert len(got) == 400 and max(got) <= 2


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def busy(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return texts

    assert labelling.retrying(busy, tries=3, wait=1, sleep=waits.append)(["a"]) == ["a"]
    assert waits == [1, 2] and len(calls) == 3
    calls.clear()
    try:
        labelling.retrying(busy, tries=2, wait=1, sleep=waits.append)(["a"])
        raise AssertionError("the last failure is raised")
    except RuntimeError:
        assert len(calls) == 2
