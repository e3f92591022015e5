"""Leakage-free train / validation / test splits.

Units (files or documents) are ordered by ``md5(seed || '|' || unit)``, a
seeded pseudo-random permutation that any engine reproduces.  The global rank
is a two-level prefix sum over hash-prefix buckets: md5 is uniform, so the
buckets are balanced whatever the key distribution, and no window ever runs
over all units in one task.  Rows are then joined back on the unit key, so
each unit lands in exactly one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's for identical results -------
SEED = 42
FRACTIONS = (0.7, 0.15, 0.15)
# ---------------------------------------------------------------------------

BUCKET_HEX = 4  # 16^4 = 65,536 hash buckets


def unit_rank(units: DataFrame, key: str, seed: int = SEED) -> tuple[DataFrame, Column]:
    """``(key, rank)`` -- 0-based rank of every distinct unit in hash order --
    and the number of units as a scalar-subquery Column."""
    u = units.select(key).where(F.col(key).isNotNull()).distinct()
    u = u.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    u = u.withColumn("_bk", F.substring("_h", 1, BUCKET_HEX))
    per = u.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    # at most 65,536 rows: the one global window here is over bucket totals
    off = per.select("_bk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy("_bk").orderBy("_h", key)
    ranks = u.join(F.broadcast(off), "_bk").select(key, (F.col("_off") + F.row_number().over(w_in) - 1).cast("long").alias("rank"))
    n = per.agg(F.sum("_n").cast("long")).scalar()
    return ranks, n


def _label(rank: Column, n_train: Column, n_val: Column) -> Column:
    return F.when(rank < n_train, "train").when(rank < n_train + n_val, "validation").otherwise("test")


def group_split(df: DataFrame, key: str = "file_name", fractions=FRACTIONS, seed: int = SEED) -> DataFrame:
    """Add ``split`` in {train, validation, test} by unit ``key``.

    Sizes follow Python's double arithmetic: ``int(0.7 * n)`` train,
    ``int(0.15 * n)`` validation, the rest test (``n`` distinct units).
    ``n`` is a scalar subquery over the bucket totals (no cross join).
    """
    ranks, n = unit_rank(df, key, seed)
    # bind the scalar subquery to one column so the plan evaluates it once
    ranks = ranks.withColumn("_n", n)
    n_train = F.floor(F.lit(float(fractions[0])) * F.col("_n"))
    n_val = F.floor(F.lit(float(fractions[1])) * F.col("_n"))
    part = ranks.select(key, _label(F.col("rank"), n_train, n_val).alias("split"))
    return df.join(part, key, "inner")


def split_sizes(split_df: DataFrame, key: str = "file_name") -> DataFrame:
    """``(split, n_units, n_rows)`` per part."""
    return split_df.groupBy("split").agg(
        F.count_distinct(key).alias("n_units"), F.count(F.lit(1)).alias("n_rows")
    )


def row_split(df: DataFrame, key: str = "id", train: float = 0.7, seed: int = SEED) -> DataFrame:
    """Two-stage split of rows (documents): ``1 - train`` held out, then the
    held-out half to validation and half to test.

    Held-out size ``ceil((1 - train) * n)`` and test size ``ceil(0.5 * m)``
    in double arithmetic (so ``1 - 0.7`` is ``0.30000000000000004``);
    validation is the rest of the held-out part.
    """
    ranks, n = unit_rank(df, key, seed)
    ranks = ranks.withColumn("_n", n).withColumn("_m", F.ceil(F.lit(1.0 - train) * F.col("_n")))
    n_train = F.col("_n") - F.col("_m")
    n_val = F.col("_m") - F.ceil(F.lit(0.5) * F.col("_m"))
    part = ranks.select(key, _label(F.col("rank"), n_train, n_val).alias("split"))
    return df.join(part, key, "inner")
