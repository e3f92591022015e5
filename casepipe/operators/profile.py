"""Profiles and summaries: value counts, null profile, label totals, shapes.

All of them are plain aggregates, so Spark pre-aggregates per partition
(partial aggregation) before the shuffle: a hot key costs one partial row per
input partition, never a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.functions.text import citation_flag, fact_flag, paragraph_ok
from casepipe.operators.segments import islands_aggs


def case_summary(paragraphs: DataFrame) -> DataFrame:
    """Per file: kept paragraphs, merged numbered paragraphs, citation and
    statute paragraph counts and kept characters (main-text filter applied).

    One aggregate over one scan: partial aggregation runs before the single
    shuffle on ``file_name``.
    """
    kept = paragraphs.where(paragraph_ok("paragraph"))
    isl_aggs, n_numbered = islands_aggs("pos", "paragraph")
    return kept.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.sum(citation_flag("paragraph")).cast("long").alias("n_citation"),
        F.sum(fact_flag("paragraph")).cast("long").alias("n_fact"),
        F.sum(F.length("paragraph")).cast("long").alias("n_chars"),
        *isl_aggs,
    ).select("file_name", "n_paragraphs", n_numbered, "n_citation", "n_fact", "n_chars")


def value_counts(df: DataFrame, col: str, dropna: bool = True, out: str = "count") -> DataFrame:
    """``(value, count)`` per distinct value; NULL kept as a value unless
    ``dropna``.  Order is by count desc, value asc when sorted by the caller."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, nulls)``: NULL count of every column, one pass."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (`column`, nulls)").select(
        "column", F.coalesce(F.col("nulls"), F.lit(0)).cast("long").alias("nulls")
    )


def label_totals(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, total)``: sum of each 0/1 label column."""
    wide = df.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in labels])
    stack = ", ".join(f"'{c}', `{c}`" for c in labels)
    return wide.selectExpr(f"stack({len(labels)}, {stack}) AS (label, total)").select(
        "label", F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("total")
    )


def paragraphs_per_file(df: DataFrame, key: str = "file_name") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_paragraphs"))


def single_paragraph_files(df: DataFrame, key: str = "file_name") -> DataFrame:
    return paragraphs_per_file(df, key).where(F.col("n_paragraphs") == 1).select(key)


def corpus_shape(df: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows, columns and distinct files of a frame (one row)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.count_distinct(key).alias("n_files"),
    )


def entity_counts(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """``(entity, count)``: number of ``B-`` tags per entity type."""
    return (
        tokens.where(F.col(tag).startswith("B-"))
        .groupBy(F.substr(F.col(tag), F.lit(3)).alias("entity"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def missing_files(scanned: DataFrame, produced: DataFrame, key: str = "file_name") -> DataFrame:
    """Files that were scanned but produced no output row (anti join)."""
    return scanned.select(key).distinct().join(produced.select(key), key, "left_anti")
