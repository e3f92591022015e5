"""Listing / search sources, joins, splits, sinks and labelling."""

import json
import os

from pyspark.sql import functions as F

from casepipe.operators import joins, labelling, ordering, splits
from casepipe.sinks import export_cases, write_csv
from casepipe.sources import html, search, tabular

LISTING = """<title>Search</title><p class="results__results-intro">23 documents found</p>
<ul class="judgment-listing__list"><li><span class="judgment-listing__title"><a> A v B/C </a></span>
<span class="judgment-listing__court">High Court</span><span class="judgment-listing__neutralcitation">[2020] EWHC 123 (Admin)</span>
<time class="judgment-listing__date" datetime="2020-01-31T00:00:00">31 Jan</time></li></ul>"""

FIELDS = {
    "title": r'(?s)<span class="judgment-listing__title">(.*?)</span>',
    "court": r'(?s)<span class="judgment-listing__court">(.*?)</span>',
    "citation": r'(?s)<span class="judgment-listing__neutralcitation">(.*?)</span>',
    "date": r'datetime="([^"]*)"',
}
LIST_RE = r'(?s)<ul class="judgment-listing__list">(.*?)</ul>'


def test_listing_and_page_plan(spark):
    pages = spark.createDataFrame([(1, LISTING), (2, "<p>nothing</p>")], "page_id INT, html STRING")
    rows = html.listing_items(pages, LIST_RE, FIELDS).collect()
    assert [(r.title, r.court, r.citation, r.date) for r in rows] == [
        ("A v B/C", "High Court", "[2020] EWHC 123 (Admin)", "2020-01-31T00:00:00")
    ]
    t = spark.createDataFrame([(1, "x", "23 documents found"), (2, "x", "1,234 documents found")], "page_id INT, base STRING, t STRING")
    t = t.withColumn("total", html.total_documents(F.col("t")))
    plan = {r.page_id: r.n for r in html.page_plan(t, "total", "base", "q").groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert plan == {1: 3, 2: 124}


def test_manifest_and_flatten(spark):
    flat = spark.createDataFrame(
        [(0, "A v B/C", "High Court", "[2020] EWHC 123 (Admin)", "2020-01-31", 3), (1, "A v B/C", "X", "[2017] UKSC 37", "d", 3)],
        "item INT, title STRING, court STRING, citation STRING, date STRING, page INT",
    )
    back = search.flatten_search_results(search.nest_results(flat)).orderBy("page_item").collect()
    assert [r.citation for r in back] == ["[2020] EWHC 123 (Admin)", "[2017] UKSC 37"]
    m = search.download_manifest(flat, order="item").collect()
    assert len(m) == 1 and m[0].target_path == "./data/xml_data/xml_page_3/A v B_C.xml"
    assert m[0].uri == "uksc/2017/37" and m[0].collisions == 2


def test_null_safe_left_merge_preserves_rows(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k STRING, v INT")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k STRING, w INT")
    got = sorted(joins.left_merge(left, right, ["k"]).collect(), key=lambda r: r.v)
    assert [(r.v, r.w) for r in got] == [(1, 10), (2, 20)]


def test_dedup_first_is_deterministic(spark):
    df = spark.createDataFrame([("f", "p", 3, "b"), ("f", "p", 1, "a"), ("g", "q", 2, "c")], "file_name STRING, paragraph STRING, pos INT, v STRING")
    got = sorted((r.file_name, r.v) for r in ordering.dedup_first(df, ["file_name", "paragraph"], ["pos"]).collect())
    assert got == [("f", "a"), ("g", "c")]


def test_consolidation_keeps_row_count(spark):
    base = spark.createDataFrame([("f", i, f"p{i % 3}") for i in range(6)], "file_name STRING, pos INT, paragraph STRING")
    ij = spark.createDataFrame([("f", "p0", 0, 1, 0), ("f", "p0", 5, 0, 1)], "file_name STRING, paragraph STRING, pos INT, introduction INT, judgment INT")
    ci = spark.createDataFrame([("f", "p1", 1, None)], "file_name STRING, paragraph STRING, pos INT, citation INT")
    fa = spark.createDataFrame([("f", "p2", 2, "Output: 1"), ("f", "p2", 4, "0")], "file_name STRING, paragraph STRING, pos INT, fact STRING")
    out = joins.consolidate_labels(base, ij, ci, fa)
    rows = sorted(out.collect(), key=lambda r: r.pos)
    assert len(rows) == 6
    assert rows[0].introduction == 1 and rows[0].paragraph_number == "The paragraph number is 1"
    assert rows[2].fact == 1 and rows[1].citation == 0


def test_text_keys_are_compared_null_safe_and_repeats_multiply(spark):
    long = "word " * 50_000
    left = spark.createDataFrame([("f", long, 1), ("f", long + "x", 2), ("f", None, 3), (None, "", 4), ("f", "", 5)], "file_name STRING, paragraph STRING, pos INT")
    right = spark.createDataFrame([("f", long, "a"), ("f", None, "b"), (None, "", "c"), ("f", long, "d")], "file_name STRING, paragraph STRING, v STRING")
    got = joins.left_merge(left, right, ["file_name", "paragraph"])
    assert got.columns == ["file_name", "paragraph", "pos", "v"]
    assert sorted((r.pos, r.v or "-") for r in got.collect()) == [(1, "a"), (1, "d"), (2, "-"), (3, "b"), (4, "c"), (5, "-")]
    assert joins.left_merge(left, right.limit(0)).where("v IS NULL").count() == 5
    numbers = right.select("file_name", F.length("paragraph").alias("paragraph"), "v")
    assert joins.left_merge(left.withColumn("paragraph", F.length("paragraph")), numbers, ["file_name", "paragraph"]).count() == 6


def test_dedup_first_groups_texts_by_digest(spark):
    df = spark.createDataFrame([("f", None, 2, "b"), ("f", None, 1, None), (None, "t", 3, "c"), ("f", "t", 4, "d"), ("f", "t", 4, "d")], "file_name STRING, paragraph STRING, pos INT, v STRING")
    got = ordering.dedup_first(df, ["file_name", "paragraph"], ["pos"])
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.where("pos <> 2").distinct().collect()))


def test_consolidation_takes_the_first_row_even_without_a_label(spark):
    base = spark.createDataFrame([("f", 0, "p"), ("f", 1, None), ("f", 2, "p")], "file_name STRING, pos INT, paragraph STRING")
    ij = spark.createDataFrame([("f", None, 0, 1, None), ("f", None, 1, 0, 1)], "file_name STRING, paragraph STRING, pos INT, introduction INT, judgment INT")
    ci = spark.createDataFrame([("f", "p", 3, 1), ("f", "p", 1, None)], "file_name STRING, paragraph STRING, pos INT, citation INT")
    fa = spark.createDataFrame([], "file_name STRING, paragraph STRING, pos INT, fact STRING")
    rows = joins.consolidate_labels(base, ij, ci, fa).orderBy("pos").collect()
    assert [(r.introduction, r.fact, r.citation, r.judgment) for r in rows] == [(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0)]


def test_frames_equal_counts_repeats(spark):
    a = spark.createDataFrame([("f", "p"), ("f", "p"), ("f", None)], "file_name STRING, paragraph STRING")
    keys = ["file_name", "paragraph"]
    assert joins.frames_equal(a, a, keys).first() == (True, 0)
    assert joins.frames_equal(a, a.distinct(), keys).first() == (False, 1)
    assert joins.frames_equal(a.limit(0), a, keys).first() == (False, 2)


def test_group_split_sizes_and_no_leak(spark):
    df = spark.createDataFrame([(f"file{i}", j) for i in range(90) for j in range(2)], "file_name STRING, pos INT")
    s = splits.group_split(df, "file_name")
    sizes = {r.split: r.n_units for r in splits.split_sizes(s).collect()}
    assert sizes == {"train": 62, "validation": 13, "test": 15}
    assert s.groupBy("file_name").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_csv_and_annotation_roundtrip(spark, scratch):
    rows = [("xml_page_2/doc_1.xml", i, f'he said "hi", {i}\nline', 0, i % 2, 0, 0) for i in range(5)]
    schema = "file_name STRING, pos INT, paragraph STRING, introduction INT, fact INT, citation INT, judgment INT"
    df = spark.createDataFrame(rows, schema)
    write_csv(df, os.path.join(scratch, "t"))
    back = tabular.read_table_csv(spark, os.path.join(scratch, "t"), schema)
    assert sorted(back.collect()) == sorted(df.collect())
    export_cases(df, os.path.join(scratch, "ann"))
    assert os.path.isdir(os.path.join(scratch, "ann", "page=2", "case=doc_1"))
    ann = tabular.read_annotations(spark, os.path.join(scratch, "ann"), schema)
    got = sorted((r.pos, r.paragraph_number) for r in ann.collect())
    assert got[0] == (0, "The paragraph number is 1") and len(got) == 5


def test_batch_label_and_resume(spark, scratch):
    df = spark.createDataFrame([("f", i, "see s.2 of it" if i % 2 else "nothing") for i in range(60)], "file_name STRING, pos INT, paragraph STRING")

    def flaky(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("service down")
        return labelling.rule_labeller(texts)

    out = labelling.batch_label(df, "paragraph", ["file_name", "pos"], fn=flaky).collect()
    assert sorted((r.pos, r.output) for r in out)[:2] == [(0, "0"), (1, "1")]
    bad = spark.createDataFrame([("f", 0, "boom")], "file_name STRING, pos INT, paragraph STRING")
    r = labelling.batch_label(bad, "paragraph", ["file_name", "pos"], fn=flaky).first()
    assert r.output is None and "service down" in r.error
    path = os.path.join(scratch, "labels")
    labelling.label_incremental(df.where("pos < 30"), path, "paragraph", ["file_name", "pos"])
    res = labelling.label_incremental(df, path, "paragraph", ["file_name", "pos"])
    assert res.count() == 60 and res.select("pos").distinct().count() == 60


def test_saved_results_are_bounded_files(spark, scratch):
    flat = spark.range(25_000).selectExpr(
        "cast(id % 10 as int) item", "concat('t', id) title", "'c' court", "'[2020] UKSC' citation", "'d' date", "cast(id div 10 + 1 as int) page"
    )
    pages = search.nest_results(flat).withColumn("page", F.get_json_object("json", "$[0].page").cast("int"))
    path = f"{scratch}/saved"
    search.write_results(pages, path, "page")
    files = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()]
    assert len(files) == 3 and max(map(len, files)) <= 1000
    back = search.flatten_search_results(search.read_results(spark, path))
    assert {(r.page, r.page_item, r.title) for r in back.collect()} == {(i // 10 + 1, i % 10, f"t{i}") for i in range(25_000)}
    search.write_results(pages.where("false"), f"{scratch}/none", "page")
    assert search.read_results(spark, f"{scratch}/none").count() == 0
