"""Evaluation metrics as aggregates over prediction tables.

NER metrics take a token table ``(doc_id, idx, true_tag, pred_tag)`` (tag
names, ``idx`` dense from 0 per document, ignored positions already
removed).  Multi-label metrics take ``(y ARRAY<INT>, logits ARRAY<DOUBLE>)``
per row.  Everything reduces to counts with partial aggregation; entities are
counted inside blocks of a document and settled across the blocks' edges, so no
document or label meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casepipe.functions.tags import TAGS, THRESHOLD, sigmoid_threshold
from casepipe.operators.segments import BLOCK_ROWS, earlier_max, neighbours, with_block
from casepipe.session import checkpoint


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _type(tag: Column) -> Column:
    return F.substring_index(tag, "-", -1)


def _begins(tag: Column, prev: Column) -> Column:
    """Whether an entity begins at ``tag``; NULL where that hangs on an unknown ``prev``."""
    return (tag != "O") & ((F.substring_index(tag, "-", 1) == "B") | (prev == "O") | (_type(tag) != _type(prev)))


def _ends(tag: Column, nxt: Column) -> Column:
    """Whether an entity ends at ``tag``; NULL where that hangs on an unknown ``nxt``."""
    return (tag != "O") & ((nxt == "O") | _begins(nxt, tag))


def _block_counts(tokens: DataFrame, doc: str, idx: str, block_rows: int) -> DataFrame:
    """One row per (document, block of ``idx``): counts of what the block alone
    decides, and its two edges.

    An entity ends on both sides at one row; it is the same entity if its type
    and its last start are equal.  ``cross`` ends have both starts before the
    rows that decide them, ``half_t`` (``half_p``) ends match if the block's
    first row begins a true (predicted) entity.
    """
    raw = tokens.select(F.col(doc).alias("_doc"), F.col(idx).cast("long").alias("_i"), "true_tag", "pred_tag")
    w = Window.partitionBy("_doc", "_blk").orderBy("_i")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = F.lit("O")
    x = with_block(raw, "_i", block_rows).select("*", F.coalesce("true_tag", o).alias("t"), F.coalesce("pred_tag", o).alias("p"))
    sides = ("t", "p")
    no = F.lit(False)
    x = x.select("*", *[F.lag(s).over(w).alias(f"_b{s}") for s in sides], *[F.lead(s).over(w).alias(f"_a{s}") for s in sides])
    x = x.select(
        *["_doc", "_blk", "_i", "true_tag", "pred_tag", "t", "p"],
        *[F.when(F.coalesce(_begins(F.col(s), F.col(f"_b{s}")), no), F.col("_i")).alias(f"start_{s}") for s in sides],
        (F.coalesce(_ends(F.col("t"), F.col("_at")), no) & F.coalesce(_ends(F.col("p"), F.col("_ap")), no) & (_type(F.col("t")) == _type(F.col("p")))).alias("both"),
    )
    x = x.select("*", F.min("_i").over(so_far).alias("_head"), *[F.max(f"start_{s}").over(so_far).alias(f"_s{s}") for s in sides])
    st, sp, both = F.col("_st"), F.col("_sp"), F.col("both")
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    y, yh = F.col("true_tag") != "O", F.col("pred_tag") != "O"
    ok = F.col("true_tag") == F.col("pred_tag")
    return x.groupBy(F.struct("_doc").alias("_d"), F.col("_blk").alias("_b")).agg(
        F.count("start_t").alias("n_true"),
        F.count("start_p").alias("n_pred"),
        count(both & (st == sp)).alias("tp"),
        count(both & st.isNull() & sp.isNull()).alias("cross"),
        count(both & st.isNull() & (sp == F.col("_head"))).alias("half_t"),
        count(both & sp.isNull() & (st == F.col("_head"))).alias("half_p"),
        F.min("_i").alias("first"),
        F.max("start_t").alias("last_t"),
        F.max("start_p").alias("last_p"),
        F.min_by(F.struct("t", "p"), "_i").alias("head"),
        F.max_by(F.struct("t", "p"), "_i").alias("tail"),
        F.count(ok).alias("n"),
        count(ok).alias("ok"),
        count(y).alias("pos"),
        count(yh).alias("pp"),
        count(y & yh).alias("tpb"),
    )


def _ner_counts(tokens: DataFrame, doc: str, idx: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of entity counts (true, predicted, both) and token counts.

    The tokens are read and shuffled once, by (document, block); the table of
    blocks, one row per 4,096 tokens of a document, is stored, and entities that
    pass a block's edge are settled there from the neighbouring blocks' edge
    tags and the last start before a block, both in levels.
    """
    sides = ("t", "p")
    b = checkpoint(_block_counts(tokens, doc, idx, block_rows))
    b = neighbours(b, "_d", "_b", ["head", "tail"])
    out = lambda edge, s: F.coalesce(F.col(edge)[s], F.lit("O"))
    # a first row that begins an entity only by the row before it
    late = lambda s: (F.substring_index(F.col("head")[s], "-", 1) != "B") & _begins(F.col("head")[s], out("prev_tail", s))
    b = b.select("*", *[late(s).alias(f"late_{s}") for s in sides])
    b = b.select("*", *[F.coalesce(F.col(f"last_{s}"), F.when(F.col(f"late_{s}"), F.col("first"))).alias(f"_own_{s}") for s in sides])
    b = earlier_max(b, "_d", "_b", ["_own_t", "_own_p"])
    at_head = {s: F.when(F.col(f"late_{s}"), F.col("first")).otherwise(F.col(f"before__own_{s}")) for s in sides}
    at_tail = {s: F.coalesce(F.col(f"last_{s}"), at_head[s]) for s in sides}
    ends = [_ends(F.col("tail")[s], out("next_head", s)) for s in sides]
    tail = ends[0] & ends[1] & (_type(F.col("tail")["t"]) == _type(F.col("tail")["p"])) & (at_tail["t"] == at_tail["p"])
    n = lambda cond: F.coalesce(cond.cast("long"), F.lit(0))
    tp = F.col("tp") + F.col("cross") * n(at_head["t"] == at_head["p"]) + F.col("half_t") * n(F.col("late_t")) + F.col("half_p") * n(F.col("late_p")) + n(tail)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return b.agg(
        total(F.col("n_true") + n(F.col("late_t"))).alias("n_true"),
        total(F.col("n_pred") + n(F.col("late_p"))).alias("n_pred"),
        total(tp).alias("tp"),
        F.try_divide(F.sum("ok"), F.sum("n")).alias("accuracy"),
        *[total(c).alias(c) for c in ("n", "pos", "pp", "tpb")],
    )


def _entity_cols() -> list[Column]:
    p = _safe_div(F.col("tp"), F.col("n_pred"))
    r = _safe_div(F.col("tp"), F.col("n_true"))
    return [p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.col("accuracy")]


def _auc_col(tp: str = "tpb") -> Column:
    base = _safe_div(F.col("pos"), F.col("n"))
    p1 = _safe_div(F.col(tp), F.col("pp"))
    r1 = _safe_div(F.col(tp), F.col("pos"))
    return F.when(F.col("pp") == 0, (base + 1) / 2).otherwise((1 - r1) * (base + p1) / 2 + r1 * (p1 + 1) / 2)


def ner_entity_scores(tokens: DataFrame, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """One row: entity-level precision, recall, F1 (micro over types) and
    token accuracy; zero division -> 0.  True and predicted entities are
    counted in one pass; a true positive ends at one row on both sides with the
    same type and start."""
    return _ner_counts(tokens, doc, idx).select(*_entity_cols(), "n_true", "n_pred", "tp")


def ner_auc_pr(tokens: DataFrame) -> DataFrame:
    """Area under the precision-recall curve of entity-vs-``O`` on hard 0/1
    predictions (trapezoid over the curve points (1, base), (r, p), (0, 1))."""
    y = (F.col("true_tag") != "O").cast("long")
    yh = (F.col("pred_tag") != "O").cast("long")
    c = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), F.sum(yh).alias("pp"), F.sum(y * yh).alias("tpb"))
    return c.select(_auc_col().alias("auc_pr"))


def tag_report(tokens: DataFrame) -> DataFrame:
    """Per tag of the vocabulary: precision, recall, F1 and support (token
    level), all from one count of (true, predicted) pairs."""
    pairs = tokens.groupBy("true_tag", "pred_tag").agg(F.count(F.lit(1)).alias("n"))
    is_true, is_pred = F.col("class") == F.col("true_tag"), F.col("class") == F.col("pred_tag")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    # every pair meets every tag of the fixed vocabulary; the vocabulary's own rows carry no count
    vocabulary = F.array(*[F.lit(t) for t in TAGS])
    none = tokens.sparkSession.range(1).select(F.lit(None).cast("string").alias("true_tag"), F.lit(None).cast("string").alias("pred_tag"), F.lit(0).cast("long").alias("n"))
    j = pairs.unionByName(none).select("*", F.explode(vocabulary).alias("class"))
    j = j.groupBy("class").agg(n(is_true).alias("support"), n(is_pred).alias("predicted"), n(is_true & is_pred).alias("tp"))
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    return j.select("class", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.col("support").cast("long"))


def ner_metrics(tokens: DataFrame, method: str = "casepipe", doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """Metric set: precision, recall, F1, accuracy, PR-AUC and ``method``,
    all from one aggregate."""
    return _ner_counts(tokens, doc, idx).select(*_entity_cols(), _auc_col().alias("auc_pr"), F.lit(method).alias("method"))


def _cells(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    pred = sigmoid_threshold(F.col(score), threshold)
    z = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), pred.alias("p"))).alias("label", "c"))
    return z.select("label", F.col("c.y").alias("y"), F.col("c.p").alias("p"))


def _per_label(cells: DataFrame) -> DataFrame:
    y, p = F.col("y").cast("long"), F.col("p").cast("long")
    return cells.groupBy("label").agg(
        F.sum(y * p).alias("tp"),
        F.sum((1 - y) * p).alias("fp"),
        F.sum(y * (1 - p)).alias("fn"),
        F.sum((1 - y) * (1 - p)).alias("tn"),
    )


def multilabel_per_label(df: DataFrame, y: str = "y", score: str = "logits", threshold: float = THRESHOLD) -> DataFrame:
    """Per label: F1 and ROC-AUC of the thresholded predictions
    (``(TPR + TNR) / 2``; NULL when the label has a single class)."""
    c = _per_label(_cells(df, y, score, threshold))
    f1 = F.when((2 * F.col("tp") + F.col("fp") + F.col("fn")) == 0, F.lit(0.0)).otherwise(
        2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    )
    pos = F.col("tp") + F.col("fn")
    neg = F.col("tn") + F.col("fp")
    auc = F.when((pos == 0) | (neg == 0), F.lit(None).cast("double")).otherwise(
        (F.col("tp") / pos + F.col("tn") / neg) / 2
    )
    return c.select("label", f1.alias("f1"), auc.alias("roc_auc"), ((pos == 0) | (neg == 0)).alias("single_class"))


def multilabel_f1(df: DataFrame, y: str = "y", score: str = "logits", threshold: float = THRESHOLD) -> DataFrame:
    return multilabel_per_label(df, y, score, threshold).agg(F.avg("f1").alias("f1"))


def multilabel_roc_auc(df: DataFrame, y: str = "y", score: str = "logits", threshold: float = THRESHOLD) -> DataFrame:
    return multilabel_per_label(df, y, score, threshold).agg(
        F.avg("roc_auc").alias("roc_auc"), F.max(F.col("single_class").cast("int")).cast("boolean").alias("undefined_label")
    )


def roc_auc_prob(df: DataFrame, y: str = "y", score: str = "logits") -> DataFrame:
    """Macro rank ROC-AUC of the scores (ties count half; labels with one class
    are left out): per label, the mean rank of the positives.

    Rows are first counted by (label, score), so equal scores meet before any
    window; the cumulative counts run in blocks over the ranked distinct scores.
    """
    cells = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(score).alias("s"))).alias("label", "c"))
    counts = cells.groupBy("label", F.col("c.s").alias("s")).agg(
        F.sum(F.col("c.y").cast("long")).alias("pos"), F.sum(1 - F.col("c.y").cast("long")).alias("neg")
    )
    # negatives below each score: ranges of scores, then inside a range
    w = Window.partitionBy("label", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranged = checkpoint(counts.repartitionByRange("label", "s").select("*", F.spark_partition_id().alias("part")))
    parts = ranged.groupBy("label", "part").agg(F.sum("neg").alias("part_neg"))
    below = F.coalesce(F.sum("part_neg").over(Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.join(parts.select("label", "part", below.alias("before")), ["label", "part"])
    wins = F.col("pos") * (F.col("before") + F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col("neg") / 2.0)
    per = ranked.select("label", "pos", "neg", wins.alias("wins")).groupBy("label").agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return per.agg(F.avg(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n")))).alias("roc_auc_prob"))


def multilabel_hamming(df: DataFrame, y: str = "y", score: str = "logits", threshold: float = THRESHOLD) -> DataFrame:
    """Mismatched cells / all cells (from the per-label confusion counts)."""
    c = _per_label(_cells(df, y, score, threshold))
    return c.agg((F.sum(F.col("fp") + F.col("fn")) / F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("hamming_loss"))


def multilabel_metrics(df: DataFrame, y: str = "y", score: str = "logits", threshold: float = THRESHOLD, method: str = "casepipe") -> DataFrame:
    """Metric set: macro ROC-AUC (thresholded), Hamming loss, macro F1, method.

    One pass: cells -> per-label confusion counts -> every metric."""
    c = _per_label(_cells(df, y, score, threshold))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1 = F.when((2 * tp + fp + fn) == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn))
    auc = F.when(((tp + fn) == 0) | ((tn + fp) == 0), F.lit(None).cast("double")).otherwise((tp / (tp + fn) + tn / (tn + fp)) / 2)
    return c.agg(
        F.avg(auc).alias("roc_auc"),
        (F.sum(fp + fn) / F.sum(tp + fp + fn + tn)).alias("hamming_loss"),
        F.avg(f1).alias("f1"),
    ).select("roc_auc", "hamming_loss", "f1", F.lit(method).alias("method"))
