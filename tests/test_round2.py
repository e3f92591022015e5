"""Regressions: long blanks, broken XML, resume, annotation layouts."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from casepipe.functions.text import FACT_PATTERN_REFERENCE, fact_flag, strip_ws
from casepipe.operators import labelling, segments
from casepipe.sinks import write_csv
from casepipe.sources import akn, tabular

AKN = "http://docs.oasis-open.org/legaldocml/ns/akn/3.0"


def test_fact_flag_equals_the_reference_pattern(spark):
    rng = random.Random(1)
    bits = ["Act", "s", "section", "Section", ".", " ", " ", "12", "(3)", "x", "A", "\n", "4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(fact_flag("t")).collect()]
    assert got == [int(bool(re.search(FACT_PATTERN_REFERENCE, t))) for t in texts]


def test_strip_equals_str_strip(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\n\x0b\x1c\x85  　") for _ in range(rng.randint(0, 8))) for _ in range(1000)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(strip_ws("t")).collect()]
    assert got == [t.strip() for t in texts]


def test_a_million_blanks_take_no_time(spark):
    df = spark.createDataFrame([("Act" + " " * 1_000_000 + "x",)], "t STRING")
    df.select(fact_flag("t"), strip_ws("t")).collect()
    t0 = time.time()
    df.select(fact_flag("t"), F.length(strip_ws("t"))).collect()
    assert time.time() - t0 < 5


def test_odd_xml_is_quarantined_not_fatal(spark):
    deep = f'<akomaNtoso xmlns="{AKN}"><judgment><judgmentBody>' + "<p>" * 3000 + "x" + "</p>" * 3000 + "</judgmentBody></judgment></akomaNtoso>"
    docs = [("deep", deep), ("enc", '<?xml version="1.0" encoding="x-none"?><a/>'), ("bad", "<a><b></a>"), ("ok", f'<judgmentBody xmlns="{AKN}"><p>fine</p></judgmentBody>')]
    df = spark.createDataFrame([(n, bytearray(x.encode())) for n, x in docs], "path STRING, content BINARY")
    kinds = {r.error_kind: r.n_files for r in akn.error_report(akn.akn_paragraph_texts(df)).collect()}
    assert kinds == {"encoding": 1, "parse": 1}
    events = akn.akn_events(df)
    assert {r.file_name for r in events.where("error IS NOT NULL").collect()} == {"enc", "bad"}
    assert events.where("file_name = 'deep'").agg(F.max("depth")).first()[0] == 3002


def test_foreign_num_opens_no_segment(spark):
    body = '<num style="a">1.</num><p>one</p><h:num xmlns:h="urn:h" style="a">9.</h:num><p>two</p>'
    df = spark.createDataFrame([("f", bytearray(f'<judgmentBody xmlns="{AKN}">{body}</judgmentBody>'.encode()))], "path STRING, content BINARY")
    got = segments.build_segments(akn.akn_events(df)).collect()
    assert [(r.seg, r.segment) for r in got] == [(1, "1. one 9. two")]


def test_failed_rows_are_tried_again(spark, scratch):
    todo = spark.createDataFrame([(i, f"text {i} " + ("bad" if i % 3 == 0 else "s.1 of the Act")) for i in range(30)], "id INT, t STRING")
    path = os.path.join(scratch, "out")
    first = labelling.label_incremental(todo, path, "t", ["id"], labelling.failing_on("bad", labelling.rule_labeller), batch_size=1)
    assert first.where("error IS NOT NULL").count() == 10
    second = labelling.label_incremental(todo, path, "t", ["id"])
    assert second.count() == 30 and second.where("error IS NOT NULL OR output IS NULL").count() == 0
    assert spark.read.parquet(path).count() == 40  # only the failed rows ran twice


def test_other_read_errors_are_raised(spark, scratch):
    path = os.path.join(scratch, "broken")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.parquet"), "wb") as f:
        f.write(b"no parquet")
    todo = spark.createDataFrame([(1, "t")], "id INT, t STRING")
    with pytest.raises(Exception):
        labelling.label_incremental(todo, path, "t", ["id"])


def test_csv_keeps_every_text(spark, scratch):
    texts = ["  lead", "trail \n", "", None, "null", 'a "q", b', "NA", "\ttab", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    write_csv(df, os.path.join(scratch, "c"))
    got = {r.i: r.t for r in tabular.read_table_csv(spark, os.path.join(scratch, "c"), "i INT, t STRING").collect()}
    assert got == dict(enumerate(texts))


def test_annotation_layouts_by_name(spark, scratch):
    for name, text in (("a/x.csv", "file_name,pos,fact,citation\nf1,1,1,0\n"), ("b/deep/y.csv", "citation,fact,pos,file_name,judgement\n1,0,1,f2,1\n0,1,2,f2,0\n")):
        os.makedirs(os.path.dirname(os.path.join(scratch, name)), exist_ok=True)
        with open(os.path.join(scratch, name), "w") as f:
            f.write(text)
    got = {tuple(r) for r in tabular.read_annotations(spark, scratch, "file_name STRING, pos INT, fact INT, citation INT, judgment INT").collect()}
    n = "The paragraph number is "
    assert got == {("f1", 1, 1, 0, None, n + "1"), ("f2", 1, 0, 1, 1, n + "1"), ("f2", 2, 1, 0, 0, n + "2")}


def test_running_count_in_levels(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "id AS pos", "CAST(id % 3 = 0 AS INT) AS f")
    got = {(r.k, r.pos): r.c for r in segments.running_count(df, "k", "pos", F.col("f"), "c", block_rows=8).collect()}
    for k in (0, 1):
        n = 0
        for p in range(k, 3000, 2):
            n += p % 3 == 0
            assert got[(k, p)] == n


def test_checkpoint_folder_of_the_application_is_kept(spark):
    from casepipe.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
