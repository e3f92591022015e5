"""Exact and near de-duplication against plain versions."""

import hashlib
import random
from collections import defaultdict

import brute
from casepipe.llm import cuckoo, lshforest
from casepipe.llm.graph import components


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_insert_delete_resize():
    index = cuckoo.CuckooIndex(2)
    for i in range(3000):
        index.add(digest(i), i, 1)
    assert index.live == 3000 and index.resizes > 5
    assert all(index.keys[index.find(digest(i))][1] == i for i in range(3000))
    for i in range(0, 3000, 2):
        index.delete(index.find(digest(i)))
    assert index.live == 1500
    assert all((index.find(digest(i)) >= 0) == (i % 2 == 1) for i in range(3000))
    assert index.find(digest("other")) == -1


def test_cuckoo_hit_is_verified():
    index = cuckoo.CuckooIndex(2)
    a = digest(1)
    twin = a[:10] + bytes(22)  # same fingerprint and bucket, another digest
    index.add(a, 5, 1)
    assert index.find(twin) == -1
    index.add(twin, 6, 1)
    assert index.live == 2 and index.keys[index.find(a)][1] == 5


def test_largest_id_stays_live():
    index = cuckoo.CuckooIndex()
    for doc_id, n in ((4, 1), (9, 2), (7, 3)):
        index.add(digest("x"), doc_id, n)
    assert list(index.rows()) == [(digest("x"), 9, 6)]


def exact(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in cuckoo.exact_dedup(df).collect()}


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = set()
    for ids in groups.values():
        best = max((i for i in ids if i is not None), default=None)
        out |= {(i, best, len(ids), i == best) for i in ids}
    return out


def test_exact_dedup_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert exact(odd_docs) == expected_exact(rows)
    assert exact(no_docs) == set()


def test_exact_dedup_sample(sample_docs):
    rows = [(r.doc_id, r.text) for r in sample_docs.collect()]
    assert exact(sample_docs) == expected_exact(rows)


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lshforest.near_dedup(df).collect()}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_dedup_families(shipped):
    rng = random.Random(5)
    rows, i = [], 100
    for n in (3, 2, 60):  # a crowded family too
        base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
        for k in range(n):
            rows.append((i, edited(base, rng, k % 8)))
            i += 1
    rows += [(i + 1, "one two three four"), (i + 2, "ONE two\tthree four"), (i + 3, ""), (i + 4, None), (i + 5, "one two three")]
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = dict(zip([r[0] for r in rows], brute.near_components(rows), strict=True))
    assert near(df) == want


def test_near_dedup_odd_rows(odd_docs, no_docs):
    got = near(odd_docs)
    assert got[0] == (0, 0, True) and got[1] == (0, 1, True) and got[2] == (0, 2, True)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False)
    assert got[10][1] == 9 and got[None][2] is True
    assert near(no_docs) == {}


def test_neighbours_across_ranges(shipped):
    # equal prefixes cut into many ranges still make one component
    base = " ".join(f"w{j}" for j in range(400))
    rows = [(i, base + f" tail{i}") for i in range(120)]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    assert {v[1] for v in near(df).values()} == {0}


def test_components_of_a_chain_and_a_star(shipped):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in components(shipped.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + k] == 100 for k in range(50))


def test_pairs_within_a_crowded_template(shipped):
    # texts below the threshold with each other, and pairs above it: 200 shingles, a template
    # of 166 (0.71) and own words; a pair shares 6 of these more (0.754)
    template = [f"t{j}" for j in range(170)]
    rows = []
    for i in range(4000):
        own = [f"o{i}x{j}" for j in range(34)]
        if i % 40 == 1:
            own[:6] = [f"o{i - 1}x{j}" for j in range(6)]
        rows.append((i * 2654435761 % 4001, " ".join(template + own)))
    at = [r[0] for r in rows]
    want = {d: d for d in at} | {max(at[i - 1 : i + 1]): min(at[i - 1 : i + 1]) for i in range(1, 4000, 40)}
    sets = [brute.shingles(rows[i][1]) for i in (0, 1, 2)]
    assert 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 72 * len(sets[0] | sets[2])
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {d: v[1] for d, v in near(df).items()} == want
