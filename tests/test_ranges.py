"""Files read in byte ranges against the whole files."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from casepipe.session import ship
from casepipe.sinks import CSV_NULL, write_csv
from casepipe.sources import iob, ranges, tabular


@pytest.fixture()
def shipped(spark):
    ship(spark)
    return spark


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return path


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_at_their_offsets(shipped, scratch, size, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", "é", " ", "\n", "\r\n", "\r", "\n\n", "x" * 30]) for _ in range(120))
    put(scratch, "t/a.txt", text)
    put(scratch, "t/deep/b.txt", "one line")
    put(scratch, "t/empty.txt", "")
    monkeypatch.setattr(ranges, "AHEAD", 5)  # in this process only; workers read with the real one
    got = ranges.read_line_offsets(shipped, os.path.join(scratch, "t"), size).orderBy("file", "at").collect()
    whole = io.StringIO(text, newline=None).read().split("\n")
    whole = whole[:-1] if whole[-1] == "" else whole
    assert [r.line for r in got if r.file.endswith("a.txt")] == whole
    data = text.encode()
    assert all(data[r.at : r.at + len(r.line.encode())].decode() == r.line for r in got if r.file.endswith("a.txt"))
    assert [(r.at, r.line) for r in got if r.file.endswith("b.txt")] == [(0, "one line")] and len({r.file for r in got}) == 2


def test_pieces_read_on_in_small_steps(scratch, monkeypatch):
    rng = random.Random(2)
    for k in range(30):
        cells = [[rng.choice(["", "a", 'q"q', "x\ny", "c,d", "\r\n", "é" * 9, '"', "\r"]) for _ in range(3)] for _ in range(12)]
        out = io.StringIO(newline="")
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=rng.choice(["\n", "\r\n"])).writerows(cells)
        data = out.getvalue().encode()
        path = put(scratch, f"{k}.csv", data if k % 2 else data.rstrip(b"\r\n"))
        for size in (1, 5, 33):
            monkeypatch.setattr(ranges, "AHEAD", 3)
            found = []
            for lo in range(0, len(data), size):
                with ranges._open("file:" + path) as f:
                    found += list(ranges._pieces(f, lo, min(lo + size, os.path.getsize(path)), data[:lo].count(b'"') & 1)) if lo < os.path.getsize(path) else []
            assert [next(csv.reader(io.StringIO(r.decode(), newline=""))) for _, r in found] == cells


@pytest.mark.parametrize("size", [13, 100, 1 << 20])
def test_csv_in_ranges_equals_the_one_task_read(shipped, scratch, size):
    texts = ["  lead", "trail \n", "", None, "null", 'a "q", b\n"', "NA", "\ttab", "x\r\ny", '"', '""', "é,\n" * 20]
    df = shipped.createDataFrame([(i, texts[i % len(texts)], i / 4) for i in range(60)], "i INT, t STRING, d DOUBLE")
    path = os.path.join(scratch, "c")
    write_csv(df.coalesce(1), path)
    got = tabular.read_table_csv(shipped, path, "i INT, t STRING, d DOUBLE", size)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    if size < 50:
        assert got.rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_every_annotation_file_is_read(shipped, scratch, size):
    """Headers with another order, further columns or without file_name, and a line of many commas."""
    put(scratch, "a/x.csv", 'file_name,pos,fact,citation\nf1,1,1,0\nf1,2,"0",1,,,\n')
    put(scratch, "a/y.csv", 'comment,citation,fact,pos,file_name,judgement\n"note, ""two""\nlines",1,0,1,f2,1\n\n,0,1,2,f2,0\n')
    put(scratch, "b/z.csv", "﻿pos,fact\r\n1,1\r\n2,0\r\n")
    put(scratch, "b/deep/w.csv", "file_name,pos,fact,paragraph\nf4,1,1,p" + "," * 10_000 + '\nf4,2,0,""\nfile_name,3,1,fact\nf4,4,,\nf4,5,1,' + CSV_NULL)
    put(scratch, "b/none.csv", "")
    put(scratch, "b/odd.csv", "nothing,known\n1,2\n")
    schema = "file_name STRING, pos INT, fact INT, citation INT, judgment INT, paragraph STRING"
    got = tabular.read_annotations(shipped, scratch, schema, size)
    assert got.columns == ["file_name", "pos", "fact", "citation", "judgment", "paragraph", "paragraph_number"]
    n = "The paragraph number is "
    want = {
        ("f1", 1, 1, 0, None, None, n + "1"), ("f1", 2, 0, 1, None, None, n + "2"),
        ("f2", 1, 0, 1, 1, None, n + "1"), ("f2", 2, 1, 0, 0, None, n + "2"),
        (None, 1, 1, None, None, None, n + "1"), (None, 2, 0, None, None, None, n + "2"),
        ("f4", 1, 1, None, None, "p", n + "1"), ("f4", 2, 0, None, None, "", n + "2"), ("file_name", 3, 1, None, None, "fact", n + "3"),
        ("f4", 4, None, None, None, None, n + "4"), ("f4", 5, 1, None, None, None, n + "5"),
        (None, None, None, None, None, None, n + "1"),
    }
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_documents_of_a_file_in_many_ranges(shipped, scratch):
    lines = []
    for d in range(40):
        lines += ["-DOCSTART- -X-", *(f"w{d}_{i}\tO" for i in range(d % 7)), ""]
    put(scratch, "f.tsv", "\n".join(lines))
    whole = [tuple(r) for r in iob.iob_documents(iob.read_lines(shipped, scratch)).select("id", "tokens").collect()]
    cut = iob.read_lines(shipped, scratch, 50)
    assert sorted(whole) == sorted(tuple(r) for r in iob.iob_documents(cut).select("id", "tokens").collect()) and len(whole) == 34
    assert cut.select(F.countDistinct("file", "line_no")).first()[0] == cut.count()
