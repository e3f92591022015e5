"""Findings of round 4: per-case folders, and paragraph numbers of annotation files."""

import csv
import io
import os

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from casepipe import sinks
from casepipe.functions.tags import TAGS
from casepipe.operators import softmax
from casepipe.plans import catalog
from casepipe.sources import iob, tabular


# ------------------------------------------------------------ F3: annotation_layouts
def test_the_driver_renames_one_folder_however_many_cases(spark, tmp_path, monkeypatch):
    renamed, real = [], sinks._file_root

    class Counted:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            if name == "rename":
                renamed.append(1)
            return getattr(self.system, name)

    def root(df, path):
        a, system, b = real(df, path)
        return a, Counted(system), b

    monkeypatch.setattr(sinks, "_file_root", root)
    rows = spark.range(40).select(F.concat(F.lit("case "), "id").alias("case"), F.lit(0).alias("pos"), F.col("id").cast("string").alias("paragraph"))
    out = str(tmp_path / "deep" / "out")
    sinks.write_grouped_csv(rows, out, ["case"], ["pos"])
    assert len(renamed) == 1
    assert sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["out"]
    assert (tmp_path / "deep" / "out" / "_SUCCESS").exists()
    back = spark.read.option("header", True).csv(out)
    assert sorted((r["case"], str(r["paragraph"])) for r in back.collect()) == sorted((f"case {i}", str(i)) for i in range(40))
    sinks.write_grouped_csv(rows.withColumn("pos", F.lit(1)), out, ["case"], ["pos"], mode="append")
    assert spark.read.option("header", True).csv(out).count() == 80
    sinks.write_grouped_csv(rows.where("id < 3"), out, ["case"], ["pos"])
    assert spark.read.option("header", True).csv(out).count() == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(4).select(F.col("id").cast("string").alias("case"), F.lit(0).alias("pos"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("x").alias("paragraph"))
    with pytest.raises(Exception, match="no"):
        sinks.write_grouped_csv(rows, str(tmp_path / "out"), ["case"], ["pos"])
    assert list(tmp_path.iterdir()) == []


def _records(text: bytes) -> list[str]:
    """The second cells of the records after the header, in order, blank records left out."""
    return [r[1] for r in list(csv.reader(io.StringIO(text.decode(), newline="")))[1:] if r]


@pytest.mark.parametrize("end", [b"\n", b"\r\n", b"\r"])
def test_paragraph_numbers_of_files_of_many_ranges(spark, tmp_path, end):
    rng = np.random.default_rng(4)
    texts = ["a", 'q "" q', "two" + end.decode() + "lines", "", "x" * 30, "," * 5]
    for k in range(3):
        lines = [b"pos,paragraph"]
        for i in range(60):
            lines += [b""] * int(rng.integers(0, 3)) + [b'%d,"%s"' % (i, texts[rng.integers(len(texts))].encode())]
        (tmp_path / f"{k}.csv").write_bytes(end.join(lines) + end * (k % 2))
    for size in (7, 64, 1 << 20):
        got = tabular.read_annotations(spark, str(tmp_path), "pos INT, paragraph STRING", size).collect()
        want = [(f"The paragraph number is {n}", t) for k in range(3) for n, t in enumerate(_records((tmp_path / f"{k}.csv").read_bytes()), 1)]
        assert sorted((r["paragraph_number"], r["paragraph"]) for r in got) == sorted(want), size


def test_annotation_files_are_read_by_one_stage(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_bytes(b"pos,paragraph\n1,a\n2,b\n")
    plan = tabular.read_annotations(spark, str(tmp_path), "pos INT, paragraph STRING")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2, plan  # the ranges' quotes, the records
    assert "Join" not in plan


# ------------------------------------------------------------ F2, F4: iob_file_roundtrip, iob_documents
def _plain(rows: list[tuple]) -> list[list[tuple[str, str]]]:
    """The documents with words of ``(file, line_no, line)``, by a loop."""
    docs = []
    for file in sorted({r[0] for r in rows}):
        docs.append([])
        for _, _, line in sorted(r for r in rows if r[0] == file):
            line = line.strip()
            if line.startswith("-DOCSTART- -X-"):
                docs.append([])
            elif line:
                docs[-1].append((line.split("\t")[0], TAG_IDS.get(line.split("\t")[-1], 0)))
    return [d for d in docs if d]


TAG_IDS = {t: i for i, t in enumerate(TAGS)}


def _lines(seed: int, n: int = 900) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for file in ("a", "b", "c"):
        at = 0
        for _ in range(n):
            at += int(rng.integers(1, 4))
            kind = rng.integers(0, 40)
            word = ["word", "é–\U0001f600", "x y", "w" * 70][rng.integers(4)]
            line = "-DOCSTART- -X- O O" if kind == 0 or (file == "a" and kind < 20) else " " if kind < 4 else word if kind == 4 else f" {word}\t_\t{[*TAGS, 'no'][rng.integers(len(TAGS) + 1)]}"
            rows.append((file, at, line))
    return rows


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
@pytest.mark.parametrize("materialize", [False, True])
def test_documents_equal_a_plain_loop(spark, block, materialize):
    rows = _lines(block, 120 if block == 1 else 900)
    df = spark.createDataFrame(rows, "file string, line_no long, line string").repartition(5, F.rand(3))
    got = iob.iob_documents(df, materialize=materialize, block=block).collect()
    assert [list(zip(r["tokens"], r["ner_tags"], strict=True)) for r in sorted(got, key=lambda r: int(r["id"]))] == _plain(rows)
    assert sorted(int(r["id"]) for r in got) == list(range(len(got)))


def test_rows_without_file_number_or_line_are_none(spark):
    rows = [("a", 1, "x\tO"), ("a", None, "y\tO"), (None, 2, "z\tO"), ("a", 3, None), ("a", 2, "v\tO")]
    got = iob.iob_documents(spark.createDataFrame(rows, "file string, line_no long, line string")).collect()
    assert [r["tokens"] for r in got] == [["x", "v"]]
    assert iob.iob_documents(spark.createDataFrame([], "file string, line_no long, line string")).collect() == []


def _on_disk(spark, prefix: str) -> int:
    """Bytes of the session's block files whose names start with ``prefix``."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith(prefix) and f.getName().endswith(".data"))


def test_stored_runs_leave_few_shuffle_bytes(spark):
    n = 200_000
    words = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") % 500 == 0, "-DOCSTART- -X- O O").otherwise(F.concat(F.md5(F.col("id").cast("string")), F.lit("\tO"))).alias("line"))
    before = _on_disk(spark, "shuffle_")
    docs = iob.iob_documents(words.repartition(8), materialize=True)
    assert _on_disk(spark, "shuffle_") - before < n  # of some 40 bytes a line; its documents' names are left
    assert docs.agg(F.sum(F.size("tokens"))).first()[0] == n - n // 500


def test_lines_written_in_runs_are_in_order(spark, tmp_path):
    rows = [(p, i, f"{p} line {i}" if i % 7 else "") for p in ("00", "01") for i in range(3, 400)] + [("00", i, f"again {i}") for i in range(50, 60)]
    df = spark.createDataFrame(rows, "part string, line_no long, line string").repartition(6, (F.col("line_no") / 11).cast("int"), "line")
    iob.write_lines(df, str(tmp_path / "out"))
    for p in ("00", "01"):
        (file,) = (tmp_path / "out" / f"part={p}").glob("part-*.txt")
        got = file.read_text().removesuffix("\n").split("\n")
        want = sorted(r[1:] for r in rows if r[0] == p)
        assert sorted(got) == sorted(line for _, line in want)
        place = {at: [line for x, line in want if x == at] for at, _ in want}
        for at in sorted(place):
            now, got = got[: len(place[at])], got[len(place[at]) :]
            assert sorted(now) == sorted(place[at])


def test_lines_without_part_number_or_text_are_written(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", None, "first"), ("a", 2, None), (None, 1, "none")]
    iob.write_lines(spark.createDataFrame(rows, "part string, line_no long, line string").repartition(1), str(tmp_path / "out"))
    assert {f.parent.name: f.read_text() for f in (tmp_path / "out").glob("part=*/part-*.txt")} == {"part=a": "first\nx\n\n", "part=__HIVE_DEFAULT_PARTITION__": "none\n"}


def test_a_token_on_the_number_of_a_start_stands_before_it(spark):
    rows = [("a", 1, "x\tO"), ("a", 2, "-DOCSTART- -X- O O"), ("a", 2, "y\tO"), ("a", 3, "z\tO")]
    for order in (rows, rows[::-1]):
        got = iob.iob_documents(spark.createDataFrame(order, "file string, line_no long, line string").coalesce(1)).collect()
        assert sorted((r["id"], r["tokens"]) for r in got) == [("0", ["x", "y"]), ("1", ["z"])]


def test_the_round_trip_drops_its_files(spark, monkeypatch):
    made, real = [], catalog._scratch
    monkeypatch.setattr(catalog, "_scratch", lambda *a: made.append(real(*a)) or made[-1])
    docs = catalog.QUERIES["iob_file_roundtrip"](spark, "/root/testdata/sf0.001")
    assert made and not os.path.exists(made[0].removeprefix("file:"))
    want = catalog.QUERIES["iob_documents"](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, docs.collect())) == sorted(map(str, want.collect()))


# ------------------------------------------------------------ F1: token_tagger
def _vectors(spark, labels, n=400, features=64):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        index, count = np.unique(rng.integers(0, features, 5) ** 2 // features, return_counts=True)
        rows.append((Vectors.sparse(features, index.tolist(), count.astype(float).tolist()), float(labels[(index[0] + (i % 5 == 0)) % len(labels)])))
    return spark.createDataFrame(rows, ["x", "y"]).repartition(3)


@pytest.mark.parametrize("most", [3, 30])
def test_all_strengths_are_fitted_as_mllib_fits_them(spark, most, monkeypatch):
    passes, real = [], softmax._summed
    monkeypatch.setattr(softmax, "_summed", lambda *a, **k: passes.append(1) or real(*a, **k))
    data = _vectors(spark, [0, 3, 1, 3, 4])
    fitted = softmax.fit(softmax.pack(data, "x", "y", 5), 5, 64, (0.01, 0.1, 0.0), most)
    evaluations = 0
    for strength, (coefficients, intercepts) in zip((0.01, 0.1, 0.0), fitted, strict=True):
        m = LogisticRegression(featuresCol="x", labelCol="y", regParam=strength, maxIter=most, family="multinomial").fit(data)
        evaluations += m.summary.totalIterations
        assert np.allclose(m.coefficientMatrix.toArray(), coefficients, rtol=1e-6, atol=1e-7)
        assert np.allclose(m.interceptVector.toArray(), intercepts, rtol=1e-6, atol=1e-7)
        same = softmax.ml_model(spark, coefficients, intercepts, "x").transform(data).select("prediction").collect()
        assert same == m.transform(data).select("prediction").collect()
    assert len(passes) < evaluations  # a pass over the rows serves every strength


def test_labels_of_one_class_or_no_rows_are_left_to_mllib(spark):
    data = _vectors(spark, [2], 20)
    assert softmax.fit(softmax.pack(data, "x", "y", 5), 5, 64, (0.1,)) is None
    assert softmax.fit(softmax.pack(data.where("y = 0"), "x", "y", 5), 5, 64, (0.1,)) is None
