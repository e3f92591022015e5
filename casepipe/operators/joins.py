"""Joins: null-safe left merges, semi/anti file filters, positional joins and
the label consolidation composite.

Texts among the join keys are compared by their SHA-256 digest (``key_columns``),
so a shuffle is dealt and sorted by 32 bytes instead of the paragraph, and the
label side leaves its texts behind at the scan.  A digest of this length needs no second look
at the texts.  Label tables are de-duplicated on the join key *before* the join, so every
left merge is many-to-one and preserves the left row count.  Broadcast is left
to Spark's size estimate and AQE's runtime statistics (a side is broadcast
only when measured under ``spark.sql.autoBroadcastJoinThreshold``); hot keys
on the left side are split by AQE's skew-join handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepipe.functions.text import normalise_label, strip_ws
from casepipe.operators.ordering import TEXT_KEYS, add_paragraph_number, key_columns, union_all

LABELS = ("introduction", "fact", "citation", "judgment")


def _null_safe_on(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    cond = None
    for c in on:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def left_merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    texts: Sequence[str] = TEXT_KEYS,
) -> DataFrame:
    """Left join on ``on`` (default: all shared columns), NULL keys equal;
    key columns among ``texts`` are compared by digest.

    Key columns appear once (from the left); other shared columns get
    ``suffixes``.  Right-side duplicates multiply rows exactly as a left merge
    does -- de-duplicate first (``dedup_first``) to preserve the row count.
    """
    shared = [c for c in left.columns if c in right.columns]
    on = list(on) if on is not None else shared
    kinds = (dict(left.dtypes), dict(right.dtypes))
    texts = [c for c in texts if c in on and kinds[0][c] == kinds[1][c] == "string"]
    l = left.select("*", *key_columns(left, on, texts)).alias("l")
    r = right.select(*[f"`{c}`" for c in right.columns if c not in on], *key_columns(right, on, texts)).alias("r")
    cond = _null_safe_on(l, r, [f"_k{i}" for i in range(len(on))])
    cols = []
    for c in left.columns:
        name = c if (c in on or c not in right.columns) else c + suffixes[0]
        cols.append(F.col(f"l.`{c}`").alias(name))
    for c in right.columns:
        if c in on:
            continue
        name = c if c not in left.columns else c + suffixes[1]
        cols.append(F.col(f"r.`{c}`").alias(name))
    return l.join(r, cond, "left").select(*cols)


def natural_left_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column (NULL-safe)."""
    return left_merge(left, right, None)


def keep_files(df: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows whose file is in ``files`` (left semi join)."""
    return df.join(files.select(key), key, "left_semi")


def drop_files(df: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows whose file is not in ``files`` (left anti join; a row without a file name stays)."""
    return df.join(files.select(key), key, "left_anti")


def fill_zero(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """NULL -> 0 in the numeric columns ``subset`` (default: all numeric)."""
    return df.fillna(0, subset=list(subset) if subset is not None else None)


def fill_cover(cover: DataFrame, prefix: DataFrame, key: str = "file_name") -> DataFrame:
    """Blank cover text replaced by the file's fallback prefix text.

    ``cover (file_name, cover_text)`` left join ``prefix (file_name,
    prefix_text)``; a cover that is blank after stripping takes the prefix,
    or ``''`` when the file has no body at all.
    """
    blank = strip_ws(F.col("cover_text")) == F.lit("")
    return cover.join(prefix, key, "left").select(
        key,
        F.when(blank, F.coalesce(F.col("prefix_text"), F.lit(""))).otherwise(F.col("cover_text")).alias("cover_text"),
    )


def positional_join(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str, cols: Sequence[str]) -> DataFrame:
    """Copy ``cols`` of ``b`` onto ``a`` by position within ``key``.

    Position = 1-based ordinal of a row inside its ``key`` group in the given
    order (a two-level prefix sum, skew safe); rows are then equi-joined on
    ``(key, position)``.
    """
    from casepipe.operators.segments import running_count

    pa = running_count(a, key, order_a, F.lit(1), "_ord")
    pb = running_count(b.select(key, order_b, *cols), key, order_b, F.lit(1), "_ord").drop(order_b)
    keep = [c for c in a.columns if c not in cols]
    return pa.select(*keep, "_ord").join(pb, [key, "_ord"], "left").drop("_ord")


def frames_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``equal`` true when the two frames hold the same multiset of
    ``keys`` tuples, plus the number of differing tuples.  The rows of both
    are counted per tuple in one aggregate, ``a`` up and ``b`` down."""
    both = a.select(*key_columns(a, keys), F.lit(1).alias("_n")).unionAll(b.select(*key_columns(b, keys), F.lit(-1)))
    diff = both.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    return diff.agg(F.count(F.lit(1)).alias("n_diff")).select(
        (F.col("n_diff") == 0).alias("equal"), F.col("n_diff").cast("long").alias("n_diff")
    )


def consolidate_labels(
    base: DataFrame,
    ij: DataFrame,
    citation: DataFrame,
    fact: DataFrame,
    key: Sequence[str] = ("file_name", "paragraph"),
) -> DataFrame:
    """Consolidate several label sources onto the base paragraph table.

    ``base (file_name, pos, paragraph)``; ``ij (file_name, paragraph, pos,
    introduction, judgment)``; ``citation (file_name, paragraph, pos,
    citation)``; ``fact (file_name, paragraph, pos, fact STRING)`` raw model
    outputs.  Each source is de-duplicated first-wins on ``(file_name,
    paragraph)`` (so row count is preserved), raw fact outputs are
    normalised to 0/1/NULL, sources are left-merged NULL-safe onto the base,
    and missing labels become 0.  Result ``(file_name, pos,
    paragraph_number, paragraph, introduction, fact, citation, judgment)``.

    The sources become one table of labels by a union and one aggregate over
    key digests, so the base is merged once and no label row carries a text.
    """
    key = list(key)
    label = {"introduction": ij, "judgment": ij, "citation": citation, "fact": fact}
    value = {c: (normalise_label(c) if c == "fact" else F.col(c)).cast("int") for c in label}
    keys = [f"_k{i}" for i in range(len(key))]

    def slim(source: DataFrame) -> DataFrame:
        own = [c for c in label if label[c] is source]
        return source.select(*key_columns(source, key), *[F.struct(F.col("pos").alias("at"), value[c].alias("v")).alias(c) for c in own])

    rows = union_all([slim(ij), slim(citation), slim(fact)])
    labels = rows.groupBy(*keys).agg(*[F.min_by(F.col(c)["v"], F.col(c)["at"]).alias(c) for c in label])
    # the ordinal depends on the base rows only: number them before the join
    out = add_paragraph_number(base.select("file_name", "pos", "paragraph"))
    l, r = out.select("*", *key_columns(out, key)).alias("l"), labels.alias("r")
    return l.join(r, _null_safe_on(l, r, keys), "left").select(
        "file_name",
        "pos",
        "paragraph_number",
        "paragraph",
        *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in LABELS],
    )
