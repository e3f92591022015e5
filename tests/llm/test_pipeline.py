"""The corpus pipeline against the operators one by one."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from casepipe.llm import ecoc

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_act(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(shipped, docs, SF)
        kept = out.select("doc_id").collect()
        ids = [r.doc_id for r in kept]
        assert len(ids) == len(set(ids)) <= before
        if name != "encode":
            assert out.columns == columns
            docs, before = corpus_pipeline.stored(out, f"test-{name}"), len(ids)
        if name == "exact_dedup":
            texts = [rows[i] for i in ids]
            assert len(set(texts)) == len(texts)
    bench = [(r.item_id, r.text) for r in shipped.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert not any(x[1] for x in brute.contaminated(left, bench))
    assert out.count() == len(left)


def test_rejects_only_texts_without_language(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_identified(shipped, docs, SF).collect()}
    gone = [r.text for r in docs.collect() if r.doc_id not in kept]
    assert all(not ecoc._letter.search(t or "") for t in gone)


def test_empty_documents(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(shipped, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_odd_documents(shipped, odd_docs):
    docs = odd_docs.withColumn("source", F.lit("x"))
    extra = [(3, "a", "en", 1, 1, "y", "x"), (None, "orphan text", "en", 1, 1, "y", "x"), (3, "a text under an id of another one", "en", 0, 0, "x", "x")]
    docs = corpus_pipeline.stored(docs.unionByName(shipped.createDataFrame(extra, docs.schema)), "test-odd")
    texts = {r.text or "" for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = corpus_pipeline.stored(stage(shipped, docs, SF), f"test-{name}")
        got = [(r.doc_id, r.text or "") for r in out.collect()]
        assert (None, "orphan text") in got and out.columns == docs.columns
        assert len({t for _, t in got}) == len(got)
        if name == "exact_dedup":
            assert {t for _, t in got} == texts and (4, "a") in got and (3, "a") not in got
            docs = out
        else:  # the two long texts are one component
            assert len(got) == len(texts) - 1 and (3, "a text under an id of another one") in got
    docs, before = odd_docs.withColumn("source", F.lit("x")), odd_docs.count()
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(shipped, docs, SF), "test-odd")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert ids.count(None) == 1 and len(ids) <= before
        before = len(ids)
