"""The midstate tree against a tree of whole hashes."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from casepipe.llm import merkle
from casepipe.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return brute.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([brute.sha("".join(n[i : i + 8])) for i in range(0, len(n), 8)])
    return levels


def climb(levels, at, node):
    """The siblings below the root and the root with node ``at`` replaced."""
    siblings = []
    for level in levels[:-1]:
        lo = at - at % 8
        run = list(level[lo : lo + 8])
        siblings += run[: at - lo] + run[at - lo + 1 :]
        run[at - lo] = node
        at, node = at // 8, brute.sha("".join(run))
    return siblings, node


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    for g in order:
        groups[g].sort(key=key)
    trees = {g: tree([leaf(r, r["text"]) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            low = None if r["text"] is None else r["text"].translate(brute.LOW)
            below, sub = climb(trees[g], i, leaf(r, low if hit else r["text"]))
            above, root = climb(top, k, sub)
            out.append((r["doc_id"], trees[g][0][i], trees[g][-1][0], top[-1][0], brute.sha("".join(below + above)), root, root == top[-1][0]))
    return sorted(out, key=str)


def rows_of(docs):
    m = merkle.Manifest(docs, *merkle.tampered())
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]
    root = m.root and m.root.hex()
    return sorted(((r.doc_id, r.leaf, r.subroot, root, r.proof_sha256, r.folded_root, r.folded_root == root) for r in m.proofs().select("doc_id", *hexed).collect()), key=str)


def made(seed, n, langs):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "Abc", "no capitals", "É Ä z", f"Text {i}"])
        out.append({"doc_id": rng.choice([i, i, i, i // 2, None]), "source": rng.choice(["s", None]), "lang": rng.choice(langs), "n_chars": rng.choice([0, 5, None]), "text": text})
    return out


def test_compression_equals_the_library():
    assert merkle.START[0] == 0x6A09E667 and merkle._ROUND[63] == 0xC67178F2
    rng = np.random.default_rng(1)
    for k in (1, 2, 9):
        texts = [rng.bytes(32 * k).hex().encode() for _ in range(20)]
        state = np.repeat(merkle.START[:, None], 20, axis=1)
        for i in range(k):
            block = np.frombuffer(b"".join(t[64 * i : 64 * i + 64] for t in texts), ">u4").astype(np.uint32).reshape(20, 16).T
            state = merkle.compress(state, block)
        assert merkle._bytes(merkle.finish(state, np.full(20, k))) == [hashlib.sha256(t).digest() for t in texts]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, ["en", None]), (300, ["en", "en", "de", None]), (400, [f"l{i}" for i in range(90)]), (65, [None])])
def test_tree_against_whole_hashes(shipped, n, langs):
    rows = made(n, n, langs)
    assert rows_of(shipped.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_many_groups(shipped):
    rows = made(3, 700, ["en", "en", "en", "de", *(f"l{i}" for i in range(30))])
    whole = rows_of(shipped.createDataFrame(rows, SCHEMA))
    assert whole == expected(rows)


def test_units_of_few_levels():
    """A group of more than one unit, folded unit by unit."""
    rng = random.Random(4)
    leaves = [brute.sha(str(i)) for i in range(merkle.UNIT + 77)]
    levels = tree(leaves)
    pos = np.arange(len(leaves))
    unit = pos // merkle.UNIT
    height = merkle._height(np.full(len(leaves), len(leaves)))
    u = merkle.Units(unit, pos, height, merkle._words([bytes.fromhex(x) for x in leaves]))
    assert [b.hex() for b in merkle._bytes(u.top)] == levels[merkle.LEVELS]
    at = rng.sample(range(len(leaves)), 50)
    other = [bytes.fromhex(x) for x in leaves]
    for i in at:
        other[i] = bytes.fromhex(brute.sha(f"x{i}"))
    got = merkle._bytes(u.fold(merkle._words(other)))
    for i in at:
        assert got[i].hex() == climb(levels[: merkle.LEVELS + 1], i, other[i].hex())[1]


def test_more_rows_than_a_unit(shipped):
    n = merkle.UNIT * 2 + 100
    rows = [{"doc_id": i, "source": "s", "lang": "en" if i % 50 else None, "n_chars": i, "text": f"T{i}"} for i in range(n)]
    assert rows_of(shipped.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_odd_rows(odd_docs, no_docs, shipped):
    docs = odd_docs.selectExpr("*", "'x' AS source", "1 AS n_chars", "7 AS pos", "'k' AS k")
    rows = [r.asDict() for r in docs.collect()]
    assert rows_of(docs) == expected(rows)
    none = no_docs.selectExpr("*", "'x' AS source", "1 AS n_chars")
    assert rows_of(none) == []


def test_query(shipped):
    got = sorted((tuple(r) for r in op12_merkle_manifest(shipped, "/root/testdata/sf0.001").collect()), key=str)
    rows = [r.asDict() for r in shipped.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got == expected(rows)
