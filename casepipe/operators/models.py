"""Model jobs on MLlib, and the token features they use.

The reference fine-tunes transformers on one GPU node; here the same
capabilities -- a multi-label paragraph classifier and an 11-way token
tagger -- are MLlib pipelines trained on the cluster (binary relevance
logistic regressions over hashed TF-IDF; multinomial logistic regression
over window features, whose training is ``softmax``'s, equal to MLlib's).  Both are fitted on the train part, the
regularisation is chosen on validation, and the test part is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from casepipe.session import checkpoint, drop_folder, ensure_checkpoint_dir, shuffles_dropped

from casepipe.operators import softmax
from casepipe.operators.segments import neighbours


#: Up to so many repeated keys are broadcast when their documents are told from the rest.
BROADCAST_KEYS = 100_000


def _features(word: str, prev: Column, nxt: Column) -> list[Column]:
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(word), r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\d", "d")
    return [prev.alias("prev_word"), nxt.alias("next_word"), shape.alias("shape"), F.substring(F.col(word), -3, 3).alias("suffix")]


def token_features(tokens: DataFrame, doc: str = "doc_id", idx: str = "idx", word: str = "word") -> DataFrame:
    """Previous / next word, word shape (``X`` upper, ``x`` lower, ``d``
    digit) and 3-character suffix.  Neighbours come from block windows
    (``segments.neighbours``), so a long document is not one task."""
    t = neighbours(tokens.select(doc, idx, word), doc, idx, [word])
    return t.select(doc, idx, word, *_features(word, F.col(f"prev_{word}"), F.col(f"next_{word}")))


def document_features(docs: DataFrame, words: str = "words", further: Mapping[str, Column] | None = None, doc: str = "doc_id") -> DataFrame:
    """``token_features`` of documents that come as rows with all their words
    in order, plus the other columns of ``docs`` and ``further`` columns
    (expressions over ``idx`` and ``word``).

    A token finds its neighbours in its own row, so nothing is shuffled.  The
    documents of a key that several rows share are taken apart first, as token
    rows; rows without a key have no features.
    """
    further = dict(further or {})
    more = [c for c in docs.columns if c not in (doc, words)]
    docs = docs.where(F.col(doc).isNotNull())
    kept = [*more, *further]

    def tokens(d: DataFrame) -> DataFrame:
        t = d.select(doc, *more, words, F.posexplode(words).alias("idx", "word"))
        return t.select("*", *[c.alias(n) for n, c in further.items()])

    def alone(d: DataFrame) -> DataFrame:
        at = lambda i: F.get(F.col(words), F.col("idx") + i)
        return tokens(d).select(doc, "idx", "word", *_features("word", at(-1), at(1)), *kept)

    shared = checkpoint(docs.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(doc))
    n = shared.count()
    if n == 0:
        return alone(docs)
    shared = F.broadcast(shared) if n <= BROADCAST_KEYS else shared
    t = tokens(docs.join(shared, doc, "left_semi"))
    rest = token_features(t, doc)
    if kept:
        rest = rest.join(t.select(doc, "idx", *kept), [doc, "idx"])
    return alone(docs.join(shared, doc, "left_anti")).unionByName(rest)


def fit_multilabel(
    df: DataFrame,
    text: str,
    labels: Sequence[str],
    split: str = "split",
    threshold: float = 0.3,
    reg_grid: Sequence[float] = (0.01, 0.1),
    num_features: int = 1 << 16,
) -> DataFrame:
    """Binary-relevance classifier; returns test rows with ``y`` (true label
    array) and ``logits`` (one raw margin per label) for the metric set."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    feats = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
            IDF(inputCol="_tf", outputCol="_x"),
        ]
    )
    train = df.where(F.col(split) == "train")
    fm = feats.fit(train)
    # cut the lineage once: every fit below iterates over these rows, and a
    # reliable checkpoint (the shared spark.checkpoint.dir) survives executor loss
    data = checkpoint(fm.transform(df).select(split, "_x", *labels))
    tr = data.where(F.col(split) == "train")
    va = data.where(F.col(split) == "validation")
    te = data.where(F.col(split) == "test")
    logit_cols = []
    out = te
    for lab in labels:
        best, best_f1 = None, -1.0
        for reg in reg_grid:
            m = LogisticRegression(featuresCol="_x", labelCol=lab, regParam=reg, maxIter=30).fit(tr.withColumn(lab, F.col(lab).cast("double")))
            pv = m.transform(va.withColumn(lab, F.col(lab).cast("double")))
            f1 = _val_f1(pv, lab, threshold)
            if f1 > best_f1:
                best, best_f1 = m, f1
        out = best.transform(out).withColumnRenamed("rawPrediction", f"_raw_{lab}").drop("probability", "prediction")
        logit_cols.append(f"_raw_{lab}")
    from pyspark.ml.functions import vector_to_array

    logits = F.array(*[F.get(vector_to_array(F.col(c)), 1) for c in logit_cols])
    return out.select(F.array(*[F.col(c).cast("int") for c in labels]).alias("y"), logits.alias("logits"))


def _val_f1(pred: DataFrame, lab: str, threshold: float) -> float:
    from pyspark.ml.functions import vector_to_array

    p = (F.get(vector_to_array(F.col("probability")), 1) >= threshold).cast("int")
    y = F.col(lab).cast("int")
    r = pred.agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn")).first()
    tp, fp, fn = (r["tp"] or 0), (r["fp"] or 0), (r["fn"] or 0)
    return 0.0 if (2 * tp + fp + fn) == 0 else 2 * tp / (2 * tp + fp + fn)


def fit_tagger(tokens: DataFrame, split: str = "split", num_features: int = 1 << 16, reg_grid: Sequence[float] = (0.01, 0.1)) -> DataFrame:
    """11-way token tagger over window features; returns test tokens with
    ``true_tag`` and ``pred_tag`` names (input for the NER metrics).

    ``tokens`` that already have their features (``document_features``) are
    used as they are.  The train part is stored packed and fitted by
    ``softmax.fit``, all strengths side by side; the vectors of the other parts are
    stored once as columns, since every validation reads them again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    from casepipe.functions.tags import tag_id, tag_name

    f = tokens
    if "prev_word" not in tokens.columns:
        f = token_features(tokens.select("doc_id", "idx", "word"))
        f = f.join(tokens.select("doc_id", "idx", "true_tag", split), ["doc_id", "idx"])
    features = [
        F.concat(F.lit("w="), F.lower("word")),
        F.concat(F.lit("p="), F.coalesce(F.lower("prev_word"), F.lit("<s>"))),
        F.concat(F.lit("n="), F.coalesce(F.lower("next_word"), F.lit("</s>"))),
        F.concat(F.lit("s="), F.col("shape")),
        F.concat(F.lit("x="), F.lower("suffix")),
    ]
    toks = F.array(*features)
    f = f.withColumn("_feat", toks).withColumn("_y", tag_id("true_tag").cast("double"))
    hashed = Pipeline(stages=[HashingTF(inputCol="_feat", outputCol="_x", numFeatures=num_features)]).fit(f).transform(f)
    spark = tokens.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/casepipe-tagger-{uuid.uuid4().hex}"
    train = hashed.where(F.col(split) == "train")
    with shuffles_dropped(spark):
        softmax.pack(train, "_x", "_y", len(features)).write.option("parquet.block.size", softmax.SPLIT).parquet(f"{path}/train")
        hashed.where(F.col(split).isin("validation", "test")).select("doc_id", "idx", "true_tag", split, "_x", "_y").write.parquet(f"{path}/rest")
    rest = spark.read.parquet(f"{path}/rest")
    va = rest.where(F.col(split) == "validation")
    te = rest.where(F.col(split) == "test")
    fitted = softmax.fit(spark.read.parquet(f"{path}/train"), len(features), num_features, reg_grid, 30)
    drop_folder(spark, f"{path}/train")
    if fitted is None:  # no tokens, or all of one tag
        models = [LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, maxIter=30, family="multinomial").fit(train) for reg in reg_grid]
    else:
        models = [softmax.ml_model(spark, *m, "_x") for m in fitted]
    best, best_acc = None, -1.0
    for m in models:
        acc = m.transform(va).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0] or 0.0
        if acc > best_acc:
            best, best_acc = m, acc
    pred = best.transform(te)
    return pred.select("doc_id", "idx", "true_tag", tag_name(F.col("prediction").cast("int")).alias("pred_tag"))
