"""Token counts, id shards and BPE against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from casepipe.llm import bytebpe, tokencount, wavelet
from casepipe.llm.common import safe_parts

ALPHABET = " \n\t'strevldmaZé1²!,　́😀 \x1c\x85_-中"


def random_texts(n=3000):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    plain = " \n\t'strevldmaZé1!,"
    return texts + ["".join(rng.choice(plain) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["x <|endoftext|> y", "<|startoftext|>"]


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    ranks = bytebpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(byte_level):
    lengths = tokencount.Lengths(byte_level, tokencount.frequent_lengths(P.path("byte_bpe_50k.json")), limit=50)
    for t in random_texts():
        assert lengths.count(t) == len(byte_level.encode(t, add_special_tokens=False)), t


def test_count_query_odd_rows(odd_docs, no_docs, byte_level):
    path = P.path("byte_bpe_50k.json")
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(odd_docs, path).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), len(byte_level.encode(r.text or "", add_special_tokens=False))) for r in odd_docs.collect()}
    assert tokencount.count_tokens(no_docs, path).count() == 0


def test_word_ids_equal_the_library(word_level):
    words = wavelet.WordIds(word_level, limit=50)
    for t in random_texts():
        assert np.frombuffer(words.encode(t), np.uint16).tolist() == word_level.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n).astype(np.uint16) * 1201
    m = wavelet.WaveletMatrix.build(ids, 16)
    assert (m.ids() == ids).all()
    for i in range(0, n, max(1, n // 50)):
        assert m.access(i) == ids[i]
    for s in {int(x) for x in ids[:5]} | {7}:
        where = np.flatnonzero(ids == s).tolist()
        assert m.rank(s, n) == len(where) and m.rank(s, n // 2) == sum(w < n // 2 for w in where)
        assert m.occurrences(s) == where and m.select(s, len(where)) == -1


def test_shards_round_trip(shipped, odd_docs, no_docs, word_level, scratch, monkeypatch):
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 3), key=lambda r: (r[0] is not None, r[0]))
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 3").repartition(3)
    wavelet.write_shards(docs, scratch + "/shards", P.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(shipped, scratch + "/shards").collect()}
    start = 0
    for doc_id, text in rows:
        ids = np.array([*word_level.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    wavelet.write_shards(no_docs, scratch + "/none", P.path("word_bpe_49k.json"))
    assert wavelet.read_documents(shipped, scratch + "/none").count() == 0


def test_bpe_equals_the_library(multi):
    bpe = bytebpe.ByteBpe(bytebpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), bytebpe.character_classes(P.PATTERN))
    texts = random_texts()
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        for t, ids in zip(part, bpe.encode_many(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == multi.encode_ordinary(t), t
            assert bpe.decode(ids) == t.encode()
            at = bpe.offsets(ids).tolist()
            assert at == sorted(at) and (not at or at[0] == 0)


def test_own_merges_equal_the_library(multi):
    ranks = bytebpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    for t in random_texts(300):
        b = t.encode()
        if b:
            assert bytebpe.merge_pairs(b, ranks) == multi._encode_single_piece(b)


def test_bpe_query_odd_rows(odd_docs, no_docs, multi):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.encode_documents(odd_docs, path, P.PATTERN).collect()}
    want = set()
    for r in odd_docs.collect():
        ids = np.array(multi.encode_ordinary(r.text or ""), "<u4")
        want.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    assert bytebpe.encode_documents(no_docs, path, P.PATTERN).count() == 0


def test_safe_parts_cut_where_pre_tokens_begin(multi):
    rng = random.Random(4)
    text = "".join(rng.choice("ab  \n'1,") for _ in range(5000))
    parts = list(safe_parts(text, 100))
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in multi.encode_ordinary(p)] == multi.encode_ordinary(text)
