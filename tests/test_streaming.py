"""Incremental annotation stream resumes from its checkpoint."""

import os

from casepipe.streaming import annotate_stream


def test_stream_resumes(spark, scratch):
    src, sink, ck = (os.path.join(scratch, d) for d in ("src", "sink", "ck"))
    rows1 = [("f", i, f"line {i} under s.{i} of the Act") for i in range(10)] + [("f", 99, "***")]
    spark.createDataFrame(rows1, "file_name STRING, pos INT, paragraph STRING").write.parquet(os.path.join(src, "b1"))
    q = annotate_stream(spark, os.path.join(src, "*"), sink, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(sink).count() == 10
    rows2 = [("g", i, f"see [2020] EWHC {100 + i} (Admin)") for i in range(5)]
    spark.createDataFrame(rows2, "file_name STRING, pos INT, paragraph STRING").write.parquet(os.path.join(src, "b2"))
    q = annotate_stream(spark, os.path.join(src, "*"), sink, ck)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 15
    assert out.where("citation = 1").count() == 5 and out.where("fact = 1").count() == 10
