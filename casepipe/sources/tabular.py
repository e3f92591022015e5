"""CSV tables and recursive annotation folders, read in byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepipe.operators.ordering import add_paragraph_number
from casepipe.sinks import CSV_NULL, CSV_OPTIONS
from casepipe.sources.ranges import RANGE, read_csv_by_name, read_csv_records


def read_table_csv(spark: SparkSession, path: str, schema: str | None = None, size: int = RANGE) -> DataFrame:
    """CSV with header as ``write_csv`` writes it: text kept verbatim, quoted
    fields may span lines.

    With ``schema`` (by position) a file is read by as many tasks as it has
    ranges of ``size`` bytes; a quote inside a field must be doubled and the
    field quoted, as ``write_csv`` does.  Without it Spark infers the types,
    and a file is one task.
    """
    if schema is None:
        return spark.read.options(**CSV_OPTIONS).option("multiLine", True).option("inferSchema", True).csv(path)
    records = read_csv_records(spark, path, size).where("at > 0")
    options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "quoteAll")}
    return records.select(F.from_csv("record", schema, options).alias("_r")).select("_r.*")


#: Column names of annotation files that mean another column.
RENAMED = {"judgement": "judgment"}


def read_annotations(spark: SparkSession, root: str, schema: str, size: int = RANGE) -> DataFrame:
    """Every annotation CSV under ``root`` at any depth, unioned by column name.

    ``schema`` lists the columns to return.  The first record of each file is
    its header, with the columns in any order: a column that a file lacks is
    NULL (``file_name`` too), further ones are dropped, cells beyond the header
    as well, and ``judgement`` is read as ``judgment`` where there is no
    ``judgment``.  No file is left out.  ``paragraph_number`` is the 1-based
    ordinal of a row in its source file, in the file's own order.
    """
    want = spark.createDataFrame([], schema).schema
    texts = read_csv_by_name(spark, root, [f.name for f in want], RENAMED, CSV_NULL, size)
    out = texts.select(F.col("file").alias("_source"), F.col("at").alias("_at"), F.col("ordinal").alias("_ordinal"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])
    return add_paragraph_number(out, "_source", "_at", ordinal="_ordinal").drop("_source", "_at", "_ordinal")
