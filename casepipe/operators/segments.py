"""Ordered-text operators: running counts, ordered concat, islands, prefixes.

Every operator here works on rows that carry an explicit integer order
(``pos`` / ``ev``) inside a group key (``file_name``).  None of them lets a
whole group meet in one task: per-group work is split into fixed-size
*blocks* of the order column (``floor(pos / block_rows)``), solved per block,
and stitched together through a small per-block table.  A document holding a
third of the corpus therefore spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepipe.functions.text import starts_with_number, strip_ws

BLOCK_ROWS = 4096


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def with_block(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS, name: str = "_blk") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(order) / F.lit(block_rows)).cast("long"))


def _block_offsets(per_block: DataFrame, keys: list[str], names: Sequence[str], block_rows: int) -> DataFrame:
    """``_off_<n>`` = sum of ``_bc_<n>`` over the earlier blocks of a key.

    Blocks are themselves dealt to blocks of blocks, so no task holds more
    than ``block_rows`` block rows of a key: only the totals of blocks of
    blocks (``rows / block_rows**2``) of a key meet in one window.
    """
    upper = F.floor(F.col("_blk") / F.lit(block_rows)).cast("long")
    # the blocks of a block of blocks travel as one row, so the input is read once
    tops = per_block.withColumn("_up", upper).groupBy(*keys, "_up").agg(
        F.collect_list(F.struct("_blk", *[f"_bc_{n}" for n in names])).alias("_b"), *[F.sum(f"_bc_{n}").alias(f"_bc_{n}") for n in names]
    )
    w_top = Window.partitionBy(*keys).orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)
    w_in = Window.partitionBy(*keys, "_up").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    z = F.lit(0)
    tops = tops.select(*keys, "_up", "_b", *[F.coalesce(F.sum(f"_bc_{n}").over(w_top), z).alias(f"_top_{n}") for n in names])
    b = tops.select(*keys, "_up", *[f"_top_{n}" for n in names], F.inline("_b"))
    return b.select(*keys, "_blk", *[(F.col(f"_top_{n}") + F.coalesce(F.sum(f"_bc_{n}").over(w_in), z)).alias(f"_off_{n}") for n in names])


def running_count(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    flag: Column,
    out: str,
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
    dtype: str = "int",
) -> DataFrame:
    """Add ``out`` = running sum of the 0/1 ``flag`` per ``keys`` in ``order``.

    Prefix sum in levels: flag totals per (key, block) -> exclusive running
    sum over blocks (a table ``block_rows`` times smaller than the input, again
    in blocks) -> joined back as an offset -> running sum inside each block.
    The join shuffles the rows, as the window has to: rows read from files look
    as small as the list of files, so Spark would broadcast all of them.
    Equivalent to
    ``sum(flag).over(partitionBy(keys).orderBy(order))`` but bounded per task.
    With ``keep_block`` the ``_blk`` column (blocks of ``order``) is kept, so a
    following ``concat_by`` in the same order reuses the partitioning.
    """
    keys = _keys(keys)
    b = with_block(df.drop("_blk") if "_blk" in df.columns else df, order, block_rows).withColumn("_flag", flag.cast("long"))
    per_block = b.groupBy(*keys, "_blk").agg(F.sum("_flag").alias("_bc_0"))
    offsets = _block_offsets(per_block, keys, ["0"], block_rows).withColumnRenamed("_off_0", "_off")
    w_in = Window.partitionBy("_blk", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    res = (
        b.join(offsets.hint("shuffle_hash"), [*keys, "_blk"], "inner")
        .withColumn(out, (F.col("_off") + F.sum("_flag").over(w_in)).cast(dtype))
        .drop("_flag", "_off")
    )
    return res if keep_block else res.drop("_blk")


def neighbours(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    cols: Sequence[str],
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>``: the values of the previous / next row
    of the same key in ``order`` (NULL at the ends).

    ``lag`` / ``lead`` run inside (key, block) windows; rows at a block edge
    take their neighbour from a per-block boundary table (first and last row
    of every block, one row per block) joined on (key, block).  The big side
    is shuffled once, by (key, block), so a hot key spreads over its blocks.
    """
    keys = _keys(keys)
    cols = list(cols)
    b = with_block(df.drop("_blk") if "_blk" in df.columns else df, order, block_rows)
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    b = b.select(
        "*",
        *[F.lag(c).over(w).alias(f"_lag_{c}") for c in cols],
        *[F.lead(c).over(w).alias(f"_lead_{c}") for c in cols],
        F.lag(F.lit(1)).over(w).isNull().alias("_is_first"),
        F.lead(F.lit(1)).over(w).isNull().alias("_is_last"),
    )
    row = F.struct(*[F.col(c) for c in cols])
    bounds = b.groupBy(*keys, "_blk").agg(
        F.min_by(row, F.col(order)).alias("_first_row"), F.max_by(row, F.col(order)).alias("_last_row")
    )
    wb = Window.partitionBy(*keys).orderBy("_blk")
    bounds = bounds.select(
        *keys,
        "_blk",
        F.lag("_last_row").over(wb).alias("_before"),
        F.lead("_first_row").over(wb).alias("_after"),
    )
    j = b.join(bounds, [*keys, "_blk"], "inner")
    out = j.select(
        *[c for c in b.columns if not c.startswith(("_lag_", "_lead_")) and c not in ("_is_first", "_is_last")],
        *[F.when(F.col("_is_first"), F.col("_before")[c]).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}") for c in cols],
        *[F.when(F.col("_is_last"), F.col("_after")[c]).otherwise(F.col(f"_lead_{c}")).alias(f"next_{c}") for c in cols],
    )
    return out if keep_block else out.drop("_blk")


def earlier_max(df: DataFrame, keys: str | Sequence[str], order: str, cols: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``before_<c>``: the largest ``c`` of the earlier rows of the same key
    (NULL where none has one), in levels as ``running_count``."""
    keys = _keys(keys)
    b = with_block(df, order, block_rows, "_up")
    w_top = Window.partitionBy(*keys).orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)
    w_in = Window.partitionBy(*keys, "_up").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "_up").agg(*[F.max(c).alias(f"_max_{c}") for c in cols])
    tops = tops.select(*keys, "_up", *[F.max(f"_max_{c}").over(w_top).alias(f"_top_{c}") for c in cols])
    return b.join(tops, [*keys, "_up"]).select(
        *df.columns, *[F.greatest(f"_top_{c}", F.max(c).over(w_in)).alias(f"before_{c}") for c in cols]
    )


def _ordered_join(order: str, value: str, sep: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), sep)


def concat_by(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    value: str,
    sep: str,
    out: str = "text",
    block_rows: int = BLOCK_ROWS,
    keep_empty_groups: bool = False,
) -> DataFrame:
    """Ordered string concat per group: ``sep.join(values sorted by order)``.

    Pre-aggregated per (group, block) so each first-level group is bounded by
    ``block_rows`` rows; the second level joins one partial string per block.
    NULL values are skipped (groups with only NULLs give no row unless
    ``keep_empty_groups``, then ``''``).  Also returns ``first_<order>`` and
    ``last_<order>`` (min and max order of the group).
    """
    keys = _keys(keys)
    # NULL values are skipped by array_join; with keep_empty_groups a group
    # whose values are all NULL still yields a row (with '')
    src = df if keep_empty_groups else df.where(F.col(value).isNotNull())
    src = src if "_blk" in src.columns else with_block(src, order, block_rows)
    partial = (
        src.groupBy(*keys, "_blk")
        .agg(_ordered_join(order, value, sep).alias("_part"), F.min(order).alias("_first"), F.max(order).alias("_last"))
    )
    return partial.groupBy(*keys).agg(
        _ordered_join("_first", "_part", sep).alias(out),
        F.min("_first").alias(f"first_{order}"),
        F.max("_last").alias(f"last_{order}"),
    )


def merge_numbered(paragraphs: DataFrame, key: str = "file_name", order: str = "pos", text: str = "paragraph") -> DataFrame:
    """Numbered-paragraph merge (gaps and islands).

    A segment opening with ``<digits>.`` starts a new paragraph; every other
    segment is appended with one space; segments before the first number form
    their own paragraph (``gid`` 0).  Result ``(file_name, gid, paragraph)``,
    each paragraph stripped at both ends.
    """
    g = running_count(paragraphs, key, order, starts_with_number(F.col(text)).cast("int"), "gid", keep_block=True)
    merged = concat_by(g, [key, "gid"], order, text, " ", out="_merged")
    return merged.select(key, "gid", strip_ws("_merged").alias(text))


def islands_aggs(order: str = "pos", text: str = "paragraph") -> tuple[list[Column], Column]:
    """Aggregates counting merged (numbered) paragraphs without building them.

    Returns ``(aggs, final)``: put ``aggs`` in a ``groupBy(...).agg`` and
    select ``final`` (``n_numbered``) afterwards.  Count of opening segments,
    plus one when un-numbered segments precede the first opener.  A plain
    aggregate, so partial aggregation bounds it per task.
    """
    starts = starts_with_number(F.col(text))
    aggs = [
        F.sum(starts.cast("long")).alias("_n_open"),
        F.min(order).alias("_first"),
        F.min(F.when(starts, F.col(order))).alias("_first_open"),
    ]
    lead = F.when(F.col("_first_open").isNull() | (F.col("_first") < F.col("_first_open")), 1).otherwise(0)
    return aggs, (F.col("_n_open") + lead).cast("long").alias("n_numbered")


# --- fixed values: markers that end the fallback cover prefix, by priority --
PREFIX_MARKERS = ("hearing date", "judgment")
# ---------------------------------------------------------------------------


def prefix_until_marker(
    paragraphs: DataFrame,
    key: str = "file_name",
    order: str = "pos",
    text: str = "paragraph",
    markers: Sequence[str] = PREFIX_MARKERS,
    sep: str = "\n",
    out: str = "prefix_text",
) -> DataFrame:
    """Fallback cover text: paragraphs up to and including the first marker.

    The first paragraph containing (case-insensitive substring) the first
    marker ends the prefix; if none does, the next marker is tried; if no
    marker occurs the whole text is used.  Joined with ``'\\n'``.
    """
    low = F.lower(F.col(text))
    hits = [F.min(F.when(low.contains(m), F.col(order))).alias(f"_m{i}") for i, m in enumerate(markers)]
    cut = paragraphs.groupBy(key).agg(*hits, F.max(order).alias("_last"))
    cut = cut.select(key, F.coalesce(*[F.col(f"_m{i}") for i in range(len(markers))], F.col("_last")).alias("_cut"))
    kept = paragraphs.join(cut, key, "inner").where(F.col(order) <= F.col("_cut"))
    return concat_by(kept, key, order, text, sep, out=out).select(key, out)


def build_segments(events: DataFrame, order: str = "reference", key: str = "file_name") -> DataFrame:
    """Numbered segments from an element-event stream.

    ``events``: ``(file_name, ev, tag, has_style, text, tail)`` in pre-order
    (``ev``), optionally with ``close_ev`` and ``depth`` for document order.
    Rules: a ``num`` with a style opens a segment (its text joins, its tail
    does not); an un-styled ``num`` is skipped entirely; any other element
    contributes its non-empty text and tail, each stripped (so whitespace-only
    pieces become ``''``).  Collection starts at the first styled ``num`` and
    runs to the end.  ``order='reference'`` emits an element's text and tail
    before its children (pre-order); ``order='document'`` puts the tail after
    the children.  Each segment is ``' '.join(pieces).strip()``; a segment
    without pieces is ``''``, except a trailing one, which is dropped.
    Result ``(file_name, seg, segment)``.
    """
    is_num = F.col("tag") == F.lit("num")
    styled = is_num & F.coalesce(F.col("has_style"), F.lit(False))
    # a parser that walks a document in order numbers the segments itself
    ev = events if "seg" in events.columns else running_count(events, key, "ev", styled.cast("int"), "seg")
    ev = ev.where(F.col("seg") >= 1)
    text_ok = F.col("text").isNotNull() & (F.length("text") > 0)
    tail_ok = F.col("tail").isNotNull() & (F.length("tail") > 0)
    take_text = text_ok & (~is_num | styled)
    take_tail = tail_ok & ~is_num
    if order == "reference":
        k_text = F.struct(F.col("ev").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
        k_tail = F.struct(F.col("ev").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c"))
    elif order == "document":
        k_text = F.struct(F.col("ev").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
        k_tail = F.struct(F.col("close_ev").alias("a"), F.lit(1).alias("b"), (-F.col("depth")).alias("c"))
    else:
        raise ValueError("order must be 'reference' or 'document'")
    pieces = ev.select(
        key,
        "seg",
        F.explode(
            F.array(
                F.when(take_text, F.struct(k_text.alias("k"), strip_ws("text").alias("v"))),
                F.when(take_tail, F.struct(k_tail.alias("k"), strip_ws("tail").alias("v"))),
                # a head without text still names its segment
                F.when(styled & ~take_text, F.struct(k_text.alias("k"), F.lit(None).cast("string").alias("v"))),
            )
        ).alias("pc"),
    ).where(F.col("pc").isNotNull())
    pieces = pieces.select(key, "seg", F.col("pc.k").alias("k"), F.col("pc.k.a").alias("_ka"), F.col("pc.v").alias("v"))
    # order inside a segment: the piece key; blocks by its leading component
    partial = (
        with_block(pieces, "_ka")
        .groupBy(key, "seg", "_blk")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("k").alias("o"), F.col("v").alias("v")))).alias("_pcs"),
        )
        .select(key, "seg", "_blk", F.col("_pcs")[0]["o"].alias("_first"), 
            F.when(F.exists("_pcs", lambda x: x["v"].isNotNull()), F.array_join(F.transform("_pcs", lambda x: x["v"]), " ")).alias("_part"))
    )
    # NULL parts are skipped by array_join; a segment of NULL parts alone has no piece
    joined = partial.groupBy(key, "seg").agg(_ordered_join("_first", "_part", " ").alias("_j"), F.count("_part").alias("_n"))
    joined = joined.select(key, "seg", F.when(F.col("_n") > 0, F.col("_j")).alias("_joined"))
    # one row per segment: a file's segments are at most its own elements
    last = F.max("seg").over(Window.partitionBy(key))
    seg = joined.withColumn("_last", last).where(F.col("_joined").isNotNull() | (F.col("seg") < F.col("_last")))
    return seg.select(key, "seg", strip_ws(F.coalesce(F.col("_joined"), F.lit(""))).alias("segment"))


def new_main_text(numbered: DataFrame, main: DataFrame, scanned: DataFrame, key: str = "file_name") -> DataFrame:
    """Fallback substitution: keep numbered paragraphs of files that have more
    than one; for files with exactly one, or none at all, take their rows of
    the main text instead.  Result ``(file_name, ord, paragraph, source)``.
    """
    per = numbered.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    multi = per.where(F.col("_n") > 1).select(key)
    keep = numbered.join(multi, key, "left_semi").select(
        key, F.col("gid").alias("ord"), "paragraph", F.lit("numbered").alias("source")
    )
    fallback = scanned.select(key).distinct().join(multi, key, "left_anti")
    sub = main.join(fallback, key, "left_semi").select(key, F.col("pos").alias("ord"), "paragraph", F.lit("main").alias("source"))
    return keep.unionByName(sub)
