"""A corpus pipeline of the operators in ``casepipe.llm``.

``run`` applies ``STAGES`` to ``documents``: each stage's rows are written as
Parquet below the shared checkpoint folder and read back as the next one's
input.  All but the last stage return the columns of ``documents``; the last
one returns ``doc_id`` with the encoded text.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casepipe.llm.common import stored, table, text_or_empty  # noqa: E402
from casepipe.session import ship  # noqa: E402


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters and those whose language stays
    undecided between two go."""
    from casepipe.llm.ecoc import UNDECIDED, identify, learn

    ship(spark)
    model = learn(docs.select("doc_id", "text", "lang"))
    d = identify(docs, model)
    return d.where((F.col("lang_pred") != UNDECIDED) & ~F.col("lang_ambiguous")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact de-duplication: of equal texts the row with the largest ``doc_id``
    stays, a null one only if there is no other; of rows that repeat both, the
    one that is least in its further columns."""
    from casepipe.llm.cuckoo import exact_dedup

    ship(spark)
    kept = exact_dedup(docs).where("kept").groupBy("digest").agg(F.first("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    rows = docs.withColumn("_digest", F.unhex(F.sha2(text_or_empty(), 256)))
    mine = (rows["_digest"] == kept["digest"]) & rows["doc_id"].eqNullSafe(kept["_id"])
    once = rows.join(kept.where("_n = 1"), mine, "left_semi").select(*docs.columns)
    least = rows.join(kept.where("_n > 1"), mine, "left_semi").groupBy("_digest").agg(F.min(F.struct(*docs.columns)).alias("_r"))
    return once.unionByName(least.select(*(F.col("_r").getField(c).alias(c) for c in docs.columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-de-duplication: of each component the row with the smallest
    ``doc_id`` stays, a null one only if there is no other.  Rows are told apart
    by a key of their own, so ids may be null or repeat."""
    from casepipe.llm.lshforest import near_dedup

    ship(spark)
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_dedup(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_r")
    keep = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(least).select("_r._row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: spans inside item windows are cut out;
    documents that consist of them for the most part go."""
    from casepipe.llm.automaton import decontaminate

    ship(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ``(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids)``."""
    import public_tokenizers

    from casepipe.llm.bytebpe import encode_documents

    ship(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    d = encode_documents(docs, path, public_tokenizers.PATTERN, keep_ids=True, keep=["lang", "source"])
    return d.drop("offsets")


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("encode", encode),
]

#: Language ID, near-de-duplication and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
