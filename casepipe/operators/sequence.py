"""Sequence tagging: the best tag path of a document by max-plus products.

A step of a path scores ``transition(previous tag, tag) + emission(token,
tag)``; products of these steps in the (max, +) algebra are associative.  So a
document is cut into blocks of tokens, each block becomes one small matrix
(best score from each tag before it to each tag at its end), blocks of blocks
are multiplied in turn until a document is one matrix, and on the way back
down each block learns the scores it is entered with and the tag it ends on.
No task holds more than ``block_rows`` tokens or matrices of a document,
however long it is.

Scores are whole thousandths, held as doubles, so sums are exact in any order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.functions.tags import TAGS, tag_id, tag_name
from casepipe.operators.segments import BLOCK_ROWS, neighbours, with_block
from casepipe.session import checkpoint

#: Scores are natural logarithms times this, rounded down.
UNIT = 1000


def allowed(before: str | None, tag: str) -> bool:
    """Whether ``tag`` may follow ``before`` (None: a document's start): an
    ``I-`` tag only continues its own kind."""
    return not tag.startswith("I-") or (before is not None and before[2:] == tag[2:] and before != "O")


def transition_scores(counts: dict[tuple[int | None, int], int], tags: Sequence[str] = TAGS) -> np.ndarray:
    """Matrix ``[len(tags) + 1, len(tags)]`` from counts of (tag before, tag);
    the last row is a document's start, ``-inf`` is what ``allowed`` forbids.
    One is added to the count of every allowed step."""
    out = np.full((len(tags) + 1, len(tags)), -np.inf)
    for i, before in enumerate([*tags, None]):
        steps = {j: counts.get((None if before is None else i, j), 0) + 1 for j, t in enumerate(tags) if allowed(before, t)}
        for j, n in steps.items():
            out[i, j] = math.floor(UNIT * math.log(n / sum(steps.values())))
    return out


def product(steps: np.ndarray) -> np.ndarray:
    """(max, +) product of step matrices in order."""
    p = steps[0]
    for s in steps[1:]:
        p = (p[:, :, None] + s[None, :-1, :]).max(axis=1)
    return p


def descend(steps: np.ndarray, entry: np.ndarray, last: int) -> tuple[list[np.ndarray], list[int]]:
    """Per step, the scores it is entered with and the tag it ends on, for the
    best path that enters with ``entry`` and ends on ``last`` (ties: lowest tag)."""
    entries = [entry]
    for s in steps[:-1]:
        entries.append(np.append((entries[-1][:, None] + s).max(axis=0), -np.inf))
    ends = [last]
    for at in range(len(steps) - 1, 0, -1):
        ends.append(int(np.argmax(entries[at] + steps[at][:, ends[-1]])))
    return entries, ends[::-1]


def tag_runs(scores: np.ndarray, starts: np.ndarray, entry: np.ndarray, last: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Tags of many runs of tokens at once (``starts``: their first rows in
    ``scores``), each as ``descend`` over its steps: entered with its row of
    ``entry``, ending on ``last`` (-1: on the best).  Step ``i`` of all the runs
    that have one is a single array operation."""
    sizes = np.diff(np.append(starts, len(scores)))
    order = np.argsort(-sizes, kind="stable")
    begin, first = starts[order], -sizes[order]
    step = transitions[:-1]
    entered = np.empty_like(scores)
    state = (entry[order][:, :, None] + transitions[None]).max(axis=1) + scores[begin]
    left = [len(begin)]
    for i in range(1, -first[0]):
        n = int(np.searchsorted(first, -i))  # the runs longer than i
        left.append(n)
        at = begin[:n] + i
        entered[at] = state[:n]
        state[:n] = (state[:n, :, None] + step[None]).max(axis=1) + scores[at]
    end = np.where(last[order] >= 0, last[order], state.argmax(axis=1))
    tags = np.empty(len(scores), np.int32)
    for i in range(len(left) - 1, -1, -1):
        at, n = begin[: left[i]] + i, left[i]
        tags[at] = end[:n]
        if i:
            end[:n] = (entered[at] + step[:, end[:n]].T).argmax(axis=1)
    return tags


def _matrices(column: pd.Series, k: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(float).reshape(len(column), k + 1, k)


#: Tokens that a task tags together.
RUN_ROWS = 1 << 16


def best_paths(tokens: DataFrame, transitions: np.ndarray, doc: str = "doc_id", idx: str = "idx", scores: str = "scores", block_rows: int = BLOCK_ROWS, keep: Sequence[str] = (), lengths: DataFrame | None = None) -> DataFrame:
    """``(doc, idx, tag)`` and the columns ``keep``: ids of the best path of every document.

    ``tokens`` has one row per ``(doc, idx)``, neither NULL, ``idx`` from 0, and
    an array of emission scores by tag id; ``lengths`` may give the largest
    ``idx`` of each document (``_last``).  Ties go to the lowest tag, seen
    from the end of a block.  Only documents of several blocks need matrices;
    a task tags the tokens of many blocks at once.
    """
    k = transitions.shape[1]
    kind = dict(tokens.dtypes)
    keep = list(keep)
    source = with_block(tokens.select(doc, idx, scores, *keep), idx, block_rows, "_b")
    state = f"`{doc}` {kind[doc]}, _b long, _entry array<double>, _end int"

    def block(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(idx)
        steps = transitions[None] + np.stack(g[scores].to_list()).astype(float)[:, None, :]
        return pd.DataFrame({doc: g[doc].iloc[:1], "_b": g["_b"].iloc[:1], "_m": [product(steps).ravel()]})

    def combine(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_b")
        return pd.DataFrame({doc: g[doc].iloc[:1], "_b": g["_up"].iloc[:1], "_m": [product(_matrices(g["_m"], k)).ravel()]})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        start = np.append(np.full(k, -np.inf), 0.0)
        last = (start[:, None] + _matrices(g["_m"], k)[0]).max(axis=0)
        return pd.DataFrame({doc: g[doc], "_b": g["_b"], "_entry": [start], "_end": [int(np.argmax(last))]})

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_b")
        entries, ends = descend(_matrices(g["_m"], k), np.asarray(g["_entry"].iloc[0], float), int(g["_end"].iloc[0]))
        return pd.DataFrame({doc: g[doc], "_b": g["_b"], "_entry": entries, "_end": ends})

    def tag(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = int(new_run(t)[-1])  # the last run may go on
                if cut:
                    yield from tagged(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield from tagged(pa.Table.from_batches(held).combine_chunks())

    def new_run(t) -> np.ndarray:
        d, b = (t.column(c).to_pandas() for c in (doc, "_b"))
        return np.flatnonzero((d != d.shift()) | (b != b.shift()))

    def tagged(t):
        i = t.column(idx).to_numpy()
        starts = new_run(t)
        entry = np.tile(np.append(np.full(k, -np.inf), 0.0), (len(starts), 1))
        last = np.full(len(starts), -1)
        known = np.flatnonzero(i < 0)  # a run's first row may hold what it is entered with and ends on
        if len(known):
            of = np.searchsorted(starts, known)
            entry[of] = t.column("_entry").take(pa.array(known)).combine_chunks().flatten().to_numpy().reshape(-1, k + 1)
            last[of] = t.column("_end").take(pa.array(known)).to_numpy()
            t = t.filter(pa.array(i >= 0))
            starts = starts - np.searchsorted(known, starts)
        x = t.column(scores).combine_chunks().flatten().to_numpy().astype(float).reshape(-1, k)
        tags = pa.array(tag_runs(x, starts, entry, last, transitions), pa.int32())
        out = t.select([doc, idx, *keep]).append_column("tag", tags)
        i = t.column(idx).to_numpy()
        if keep and (i[1:] == i[:-1]).any():  # of a place given twice, each row gets each tag
            g = pd.Series(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(i)))))
            p = pd.DataFrame({"g": g, "i": i, "r": np.arange(len(i))})
            both = p.merge(p, on=["g", "i"])
            out = out.take(pa.array(both["r_x"])).drop_columns("tag").append_column("tag", tags.take(pa.array(both["r_y"])))
        yield from out.to_batches()

    matrix = f"`{doc}` {kind[doc]}, _b long, _m array<double>"
    lengths = tokens.groupBy(doc).agg(F.max(idx).alias("_last")) if lengths is None else lengths
    long = checkpoint(lengths.where(F.col("_last") >= block_rows).select(doc))
    rows = source.withColumn("_entry", F.lit(None).cast("array<double>")).withColumn("_end", F.lit(None).cast("int"))
    if long.count():
        levels = [checkpoint(source.join(long, doc, "left_semi").groupBy(doc, "_b").applyInPandas(block, matrix))]
        while (levels[-1].agg(F.max("_b")).first()[0] or 0) > 0:
            up = with_block(levels[-1], "_b", block_rows, "_up")
            levels.append(checkpoint(up.groupBy(doc, "_up").applyInPandas(combine, matrix)))
        known = levels[-1].groupBy(doc, "_b").applyInPandas(whole, state)
        for level in reversed(levels[:-1]):
            children = with_block(level, "_b", block_rows, "_up").join(known.withColumnRenamed("_b", "_up"), [doc, "_up"])
            known = checkpoint(children.groupBy(doc, "_up").applyInPandas(spread, state))
        rows = rows.unionByName(known.withColumn(idx, F.lit(-1).cast(kind[idx])), allowMissingColumns=True)
    else:
        rows = rows.drop("_entry", "_end")
    runs = rows.repartition(doc, "_b").sortWithinPartitions(doc, "_b", idx)
    out = [f"`{c}` {kind[c]}" for c in (doc, idx, *keep)]
    return runs.mapInArrow(tag, ", ".join([*out, "tag int"]))


def learned_scores(tokens: DataFrame, split: str = "split") -> tuple[DataFrame, np.ndarray]:
    """Emission scores of the ``test`` tokens and the transition matrix, both
    from counts over ``train``: word and last three characters given the tag,
    tag given the tag before.  The driver sees one count per pair of tags.  A
    word's scores are computed once, from the counts of the distinct words."""
    k = len(TAGS)
    f = tokens.select("doc_id", "idx", split, "true_tag", tag_id("true_tag").alias("_t"), F.lower("word").alias("_w"))
    train = f.where(F.col(split) == "train")
    follows = neighbours(train.select("doc_id", "idx", "_t"), "doc_id", "idx", ["_t"]).groupBy("prev__t", "_t").count().collect()
    by_tag = [0] * k
    for r in follows:
        by_tag[r["_t"]] += r["count"]

    learned = (F.col(split) == "train").cast("long")
    counted = [F.sum(learned * (F.col("_t") == i).cast("long")).alias(f"_n{i}") for i in range(k)]
    words = f.where(F.col("_w").isNotNull() & F.col(split).isin("train", "test")).groupBy("_w").agg(F.max(learned).alias("_in"), *counted)
    words = checkpoint(words.withColumn("_x", F.substring("_w", -3, 3)))
    known = words.where("_in = 1")
    ends = checkpoint(known.groupBy("_x").agg(*[F.sum(f"_n{i}").alias(f"_e{i}") for i in range(k)]))
    n_words, n_ends = known.count(), ends.count()

    def score(i: int, word, end):
        of = lambda c, kinds: F.log((F.coalesce(c, F.lit(0)) + 1) / F.lit(float(by_tag[i] + kinds + 1)))
        return F.floor(F.lit(UNIT) * (of(word, n_words) + of(end, n_ends))).cast("double")

    # written once: the join then reads a plain table, so that Spark can split the tokens of a frequent word
    of_word = words.join(ends, "_x", "left").select("_w", F.array(*[score(i, F.col(f"_n{i}"), F.col(f"_e{i}")) for i in range(k)]).alias("_s"))
    unknown = F.array(*[score(i, F.lit(0), F.lit(0)) for i in range(k)])
    j = f.where(F.col(split) == "test").join(checkpoint(of_word), "_w", "left")
    emitted = j.select("doc_id", "idx", "true_tag", F.coalesce("_s", unknown).alias("scores"))
    return emitted, transition_scores({(r["prev__t"], r["_t"]): r["count"] for r in follows})


def tag_sequences(tokens: DataFrame, split: str = "split", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sequence tagger learned on ``train``: the ``test`` tokens with
    ``true_tag`` and ``pred_tag``, tags of a document decided together, so that
    each ``I-`` tag continues a tag of its kind."""
    emitted, transitions = learned_scores(tokens, split)
    lengths = tokens.where(F.col(split) == "test").groupBy("doc_id").agg(F.max("idx").alias("_last"))
    paths = best_paths(emitted, transitions, block_rows=block_rows, keep=["true_tag"], lengths=lengths)
    return paths.select("doc_id", "idx", "true_tag", tag_name("tag").alias("pred_tag"))
