import random
import re

import numpy as np
import pytest

from airwell.llm import minhash
from airwell.llm._graph import components
from tests.llm.conftest import PROSE

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    holders = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    pairs = {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def compare(spark, rows, threshold):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, threshold).collect()
    want = brute(rows, round(100 * threshold))
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t))) for i, t in rows)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10 ** 6)}" for w in words)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_groups_chains_and_shared_passages(spark, threshold):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    base = rng.choices(vocabulary, k=150)
    rows += [edited(rng, base, s) for s in [0.005, 0.01, 0.02, 0.03, 0.04] * 24]     # one large group, links and non-links
    rows += [" ".join(base)] * 30                                                    # copies
    passage = rng.choices(vocabulary, k=60)
    rows += [" ".join(rng.choices(vocabulary, k=40) + passage + rng.choices(vocabulary, k=10)) for _ in range(60)]
    chain = rng.choices(vocabulary, k=120)
    for _ in range(12):                                                              # each like the next only
        rows.append(" ".join(chain))
        chain = chain[6:] + rng.choices(vocabulary, k=6)
    rng.shuffle(rows)
    compare(spark, list(enumerate(rows)), threshold)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    compare(spark, rows, 0.85)
    compare(spark, [(1, PROSE), (2, PROSE.upper()), (3, "One two"), (4, "one  TWO"), (5, "É è"), (6, "é è"), (7, " ")], 0.85)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.filter_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 8, 9, 10, None}


def test_circulant_windows_are_shifted_permutations():
    s = next(minhash.shingle_sets(["a b c d e f g h"]))
    sig = minhash.signature(s)
    _, windows = minhash._tables()
    cells = (minhash._mix(s ^ np.uint64(minhash.SIGMA)) >> np.uint64(64 - minhash.DOMAIN_BITS)).astype(int)
    size = 1 << minhash.DOMAIN_BITS
    pi = windows[:, 0][:size]
    for k in (0, 1, 100, 255):
        assert sig[k] == min(pi[(c + k) % size] for c in cells)


def test_hashing_in_pieces_gives_the_same_sets():
    texts = [PROSE * 40, None, "", "one", "  lead and trail  ", "ß é"] * 60
    alone = [next(minhash.shingle_sets([t])) for t in texts]
    for a, b in zip(alone, minhash.shingle_sets(texts)):
        assert np.array_equal(a, b)


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (5000, 4999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert got[5000] == got[4999] == 4999 and len(got) == 201 + 300 + 2


@pytest.mark.parametrize("minor", [1000, 4, 2])
@pytest.mark.parametrize("bands", [2, 3, 5])
def test_wide_buckets_lose_no_pair(spark, monkeypatch, minor, bands):
    """Hand-made: twelve documents of as many components that share exactly ``bands`` bands meet in all pairs, however wide
    a bucket may be before it is split; documents that share one band never do."""
    monkeypatch.setattr(minhash, "MINOR", minor)
    ids = list(range(12))
    shared, marks = [(k, i) for k in range(bands) for i in ids], [(i, [1, 2, 3, 4]) for i in ids]
    shared += [(90, i) for i in (0, 20, 21, 22, 23)] + [(100 + i, i) for i in ids]      # one common band, or a band of one's own
    marks += [(i, [1, 2, 3, 4]) for i in range(20, 24)]
    buckets = spark.createDataFrame(shared, "key long, id long")
    rows = buckets.selectExpr("array(key) as used", "id", "10 as n", "id as component", "0L as own")
    got = minhash._mixed_pairs(rows, buckets, spark.createDataFrame(marks, "doc_id long, marks array<int>"), 80, 2, 3).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, j) for i in ids for j in ids if i < j]
