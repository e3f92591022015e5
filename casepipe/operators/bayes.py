"""Closed-form models: naive Bayes from grouped counts.

Training is one aggregate per feature and scoring one join with the counts,
so both are plain Spark plans whose results SQL can recompute.  Smoothing
adds one to every count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.functions.tags import TAGS, tag_id
from casepipe.session import checkpoint


def multilabel_bayes(df: DataFrame, text: str, labels: Sequence[str], keys: Sequence[str], split: str = "split") -> DataFrame:
    """Multinomial naive Bayes for each label over the blank-separated
    lower-case words of a text, learned on ``train``; the ``test`` rows with
    ``y`` and ``logits`` (log-odds of each label).

    The words of a test row are counted before they are joined with the counts.
    """
    labels, keys = list(labels), list(keys)
    words = df.select(*keys, split, *labels, F.explode(F.split(F.lower(text), " ", -1)).alias("w"))
    # the counts need no rows: only the words of test rows are dealt out by row
    train = words.where(F.col(split) == "train")
    counts = train.groupBy("w").agg(*[F.sum(F.col(c).cast("long")).alias(f"_p{i}") for i, c in enumerate(labels)], F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.count(F.lit(1)).alias("_v"), F.sum("_n").alias("_t"), *[F.sum(f"_p{i}").alias(f"_t{i}") for i in range(len(labels))])
    prior = df.where(F.col(split) == "train").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_r{i}") for i, c in enumerate(labels)])
    one = total.select(F.struct("*")).scalar()
    base = prior.select(F.struct("*")).scalar()

    def odds(i: int):
        yes = (F.coalesce(F.col(f"_p{i}"), F.lit(0)) + 1) / (one[f"_t{i}"] + one["_v"])
        no = (F.coalesce(F.col("_n") - F.col(f"_p{i}"), F.lit(0)) + 1) / (one["_t"] - one[f"_t{i}"] + one["_v"])
        return F.sum(F.col("n") * (F.log(yes) - F.log(no))).alias(f"_s{i}")

    test = words.where(F.col(split) == "test").groupBy(*keys, split, *labels, "w").agg(F.count(F.lit(1)).alias("n"))
    test = test.join(counts, "w", "left")
    scores = test.groupBy(*keys, *labels).agg(*[odds(i) for i in range(len(labels))])
    first = lambda i: F.log((base[f"_r{i}"] + 1) / (base["_rows"] - base[f"_r{i}"] + 1))
    return scores.select(
        F.array(*[F.col(c).cast("int") for c in labels]).alias("y"),
        F.array(*[F.col(f"_s{i}") + first(i) for i in range(len(labels))]).alias("logits"),
    )


def token_bayes(tokens: DataFrame, split: str = "split") -> DataFrame:
    """Tagger by naive Bayes over the lower-case word and its last three
    characters, learned on ``train``; the ``test`` tokens with ``true_tag`` and
    ``pred_tag`` (ties go to the lower tag id)."""
    f = tokens.select("doc_id", "idx", split, "true_tag", tag_id("true_tag").alias("_t"), F.lower("word").alias("w"))
    k = len(TAGS)
    # one read of the tokens: all counts come from those of the distinct words, written once
    learned = (F.col(split) == "train").cast("long")
    per_word = [F.sum(learned * (F.col("_t") == i).cast("long")).alias(f"_n{i}") for i in range(k)]
    words = f.where(F.col(split).isin("train", "test")).groupBy("w").agg(F.max(learned).alias("_in"), *per_word)
    words = checkpoint(words.withColumn("x", F.substring("w", -3, 3)))
    known = words.where(F.col("_in") == 1)
    of_tags = lambda name: F.array(*[F.sum(f"_n{i}") for i in range(k)]).alias(name)
    by_end = known.groupBy("x").agg(of_tags("_x"))
    n_words, n_ends = known.agg(F.count(F.lit(1))).scalar(), by_end.agg(F.count(F.lit(1))).scalar()
    size = known.agg(of_tags("_size")).scalar()

    def score(i: int):
        n = F.get(size, F.lit(i))
        own = F.when(F.col("w").isNotNull(), F.col(f"_n{i}")).otherwise(F.lit(0)) + 1  # a NULL word is no other's equal
        end = F.coalesce(F.get("_x", F.lit(i)), F.lit(0)) + 1
        return F.log(n + 1) + F.log(own / (n + n_words)) + F.log(end / (n + n_ends))

    # a word's tokens all get one tag
    scores = words.join(by_end, "x", "left").select("w", F.array(*[score(i) for i in range(k)]).alias("_s"))
    best = F.array_position("_s", F.array_max("_s")).cast("int") - 1
    tagged = scores.select(F.col("w").alias("_w"), F.get(F.array(*[F.lit(t) for t in TAGS]), best).alias("pred_tag"))
    test = f.where(F.col(split) == "test").join(tagged, F.col("w").eqNullSafe(F.col("_w")))
    return test.select("doc_id", "idx", "true_tag", "pred_tag")


def tag_counts(pred: DataFrame) -> DataFrame:
    """``(true_tag, pred_tag, n)``: the confusion table."""
    return pred.groupBy("true_tag", "pred_tag").agg(F.count(F.lit(1)).alias("n"))
