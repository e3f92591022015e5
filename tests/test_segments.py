"""Ordered-text operators and the skew-safe running count."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from casepipe.operators import segments


def test_running_count_matches_window_over_many_blocks(spark):
    # one hot key holding most rows, spread over many blocks of 7 rows
    rows = [("hot", i, int(i % 5 == 0)) for i in range(500)] + [("k%d" % j, i, int(i % 2 == 0)) for j in range(5) for i in range(9)]
    df = spark.createDataFrame(rows, "k STRING, pos INT, f INT")
    got = segments.running_count(df, "k", "pos", F.col("f"), "rc", block_rows=7)
    want = df.withColumn("rc", F.sum("f").over(Window.partitionBy("k").orderBy("pos")).cast("int"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_concat_by_blocks(spark):
    rows = [("a", i, f"w{i}") for i in range(50)] + [("b", 3, None), ("b", 1, "x")]
    df = spark.createDataFrame(rows, "k STRING, pos INT, v STRING")
    got = {r.k: r.text for r in segments.concat_by(df, "k", "pos", "v", "-", block_rows=4).collect()}
    assert got == {"a": "-".join(f"w{i}" for i in range(50)), "b": "x"}


def test_merge_numbered(spark):
    rows = [("f", 0, "intro"), ("f", 1, "more"), ("f", 2, "1. one"), ("f", 3, "(a) sub"), ("f", 4, "2. two ")]
    df = spark.createDataFrame(rows, "file_name STRING, pos INT, paragraph STRING")
    got = sorted((r.gid, r.paragraph) for r in segments.merge_numbered(df).collect())
    assert got == [(0, "intro more"), (1, "1. one (a) sub"), (2, "2. two")]


def test_islands_summary_counts(spark):
    rows = [("f", 0, "intro"), ("f", 2, "1. one"), ("g", 0, "1. x"), ("g", 1, "2. y"), ("h", 5, "plain")]
    df = spark.createDataFrame(rows, "file_name STRING, pos INT, paragraph STRING")
    aggs, n_numbered = segments.islands_aggs()
    got = {r.file_name: r.n_numbered for r in df.groupBy("file_name").agg(*aggs).select("file_name", n_numbered).collect()}
    assert got == {"f": 2, "g": 2, "h": 1}


def test_prefix_until_marker(spark):
    rows = [
        ("a", 0, "x"), ("a", 1, "JUDGMENT"), ("a", 2, "y"), ("a", 3, "Hearing date: 1"), ("a", 4, "z"),
        ("b", 0, "x"), ("b", 1, "Judgment"), ("b", 2, "y"),
        ("c", 0, "x"), ("c", 1, "y"),
    ]
    df = spark.createDataFrame(rows, "file_name STRING, pos INT, paragraph STRING")
    got = {r.file_name: r.prefix_text for r in segments.prefix_until_marker(df).collect()}
    assert got == {"a": "x\nJUDGMENT\ny\nHearing date: 1", "b": "x\nJudgment", "c": "x\ny"}


def test_neighbours_across_blocks(spark):
    rows = [("hot", i, f"w{i}") for i in range(60)] + [("k", 0, "a"), ("k", 1, "b")]
    df = spark.createDataFrame(rows, "k STRING, pos INT, v STRING")
    got = {(r.k, r.pos): (r.prev_v, r.next_v) for r in segments.neighbours(df, "k", "pos", ["v"], block_rows=7).collect()}
    for i in range(60):
        assert got[("hot", i)] == (f"w{i-1}" if i else None, f"w{i+1}" if i < 59 else None)
    assert got[("k", 0)] == (None, "b") and got[("k", 1)] == ("a", None)
