"""De-duplication, ordinals, ordering and unions.

First-wins de-duplication is an aggregate (``min_by`` over the order key),
not a window: Spark combines it per partition before the shuffle, so a key
repeated a billion times costs one partial row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepipe.operators.segments import running_count

# --- fixed values: must equal the reference's for identical results -------
PARAGRAPH_NUMBER_PREFIX = "The paragraph number is "
# ---------------------------------------------------------------------------

#: Key columns that hold whole texts.
TEXT_KEYS = ("paragraph",)


def key_columns(df: DataFrame, on: Sequence[str], texts: Sequence[str] = TEXT_KEYS) -> list[Column]:
    """``_k0, _k1, ...``: the key columns ``on``, string columns among ``texts``
    as their SHA-256 digest (NULL stays NULL)."""
    kinds = dict(df.dtypes)
    digest = lambda c: F.unhex(F.sha2(F.col(f"`{c}`"), 256)) if c in texts and kinds[c] == "string" else F.col(f"`{c}`")
    return [digest(c).alias(f"_k{i}") for i, c in enumerate(on)]


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], texts: Sequence[str] = TEXT_KEYS) -> DataFrame:
    """Keep, per ``keys`` (NULL equal to NULL), the row first in ``order``.

    Deterministic, unlike ``dropDuplicates``: ``min_by(row, order)``.  Keys
    among ``texts`` are grouped by digest; the row that stays carries the text.
    """
    by = key_columns(df, keys, texts)
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*by, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"), F.struct(*[F.col(c) for c in order]).alias("_o"))
    return rows.groupBy(*names).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def dedup_all(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (all columns)."""
    return df.distinct()


def add_paragraph_number(df: DataFrame, key: str = "file_name", order: str = "pos", out: str = "paragraph_number", ordinal: str | None = None) -> DataFrame:
    """``'The paragraph number is ' || i`` with ``i`` the 1-based ordinal of
    the row in its file.  The ordinal is a skew-safe two-level prefix sum, or the
    column ``ordinal`` of rows that their reader has numbered."""
    numbered = running_count(df, key, order, F.lit(1), "_i") if ordinal is None else df.withColumn("_i", F.col(ordinal))
    return numbered.withColumn(out, F.concat(F.lit(PARAGRAPH_NUMBER_PREFIX), F.col("_i").cast("string"))).drop("_i")


def sorted_paragraphs(df: DataFrame, by: Sequence[str] = ("file_name", "paragraph")) -> DataFrame:
    """Global sort (range-partitioned by Spark, no single-task sort)."""
    return df.orderBy(*by)


def head_rows(df: DataFrame, n: int = 5, by: Sequence[str] = ("file_name", "pos")) -> DataFrame:
    """First ``n`` rows in key order (a top-k: per-partition top-n, then merge)."""
    return df.orderBy(*by).limit(n)


def distinct_files(df: DataFrame, key: str = "file_name", order: str = "pos") -> DataFrame:
    """Distinct files with the order of their first appearance."""
    return df.groupBy(key).agg(F.min(order).alias(f"first_{order}"))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing from a frame become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
