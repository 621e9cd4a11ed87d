import numpy as np
import pytest
from pyspark.sql import functions as F

from airwell.llm import hard_negatives as hn
from airwell.llm.queries import op12_hard_negatives
from tests.conftest import SF01

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<double>, label long"


def brute(rows, is_anchor, positives=5, negatives=10):
    """Rows (id, whole vector, label) by plain sorting, with Python's own numbers."""
    out = []
    for own, q, label in (r for r in rows if is_anchor(r[0])):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, other) for i, v, other in rows if i != own and len(v) == len(q))
        same = [(-s, i) for s, i, other in scored if other == label][:positives]
        for p, i in same:
            fit = [(-s, j) for s, j, other in scored if other != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(own, i, k, j, p, s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def whole(rows):
    return [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    assert got(op12_hard_negatives(spark, SF01)) == brute(whole(rows), lambda i: i % 100 == 0)


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "hot label"])
def test_many_blocks_against_brute_force(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 64), ("STRETCH", 3), ("UNIT", 5), ("LEAF", 4), ("PIVOT_SAMPLE", 50)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(3)
    n, d = 700, 8
    x = rng.standard_normal((n, d))
    if kind == "clusters":
        x = rng.standard_normal((9, d))[rng.integers(0, 9, n)] * 3 + 0.1 * x
    if kind == "ties":
        x = rng.integers(0, 2, (n, d)) / 256.0 * 3
    labels = np.where(rng.random(n) < 0.6, 1, rng.integers(0, 6, n)) if kind == "hot label" else rng.integers(0, 4, n)
    rows = [(int(i), v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hn.mine(df, lambda i: i % 10 == 0)) == brute(whole(rows), lambda i: i % 10 == 0)


def test_cover_tree_covers():
    rng = np.random.default_rng(9)
    for x in (rng.standard_normal((300, 5)) * 100, np.repeat(rng.integers(-9, 9, (7, 3)), 20, axis=0).astype(float), np.zeros((4, 2))):
        top2 = float((x * x).sum(axis=1).max())
        order, stop, radius, parent = hn.cover_tree(x, top2)
        y = hn._lifted(x, top2)[order]
        assert sorted(order) == list(range(len(x))) and stop[0] == len(x)
        for i in range(len(x)):
            below = y[i:stop[i]]
            assert np.sqrt(((below - y[i]) ** 2).sum(axis=1)).max() <= radius[i] + 1e-4 * np.sqrt(top2)
            assert i == 0 or parent[i] < i < stop[parent[i]]


def test_search_leaves_nodes_out(monkeypatch):
    """In clustered vectors most rows are never scored."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16)) * 400
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.standard_normal((2000, 16)))
    top2 = float((x * x).sum(axis=1).max())
    table = pa.table({"block": pa.array(np.zeros(2000, dtype=np.int64)), "pos": pa.array(np.arange(2000)),
                      "dim": pa.array(np.full(2000, 16, dtype=np.int32)), "id": pa.array(np.arange(2000)),
                      "label": pa.array(np.arange(2000) % 3), "q": pa.array(list(x), pa.list_(pa.float64()))})
    forest = hn._forests(hn._build(top2)(None, table), top2)[16]
    seen, plain = [0], hn._Forest.scores
    monkeypatch.setattr(hn._Forest, "scores", lambda self, rows, q: seen.__setitem__(0, seen[0] + len(rows)) or plain(self, rows, q))
    (s, ids), = hn.descend(forest, x[5], 5, 2, True, [hn.LONG.min], [hn.LONG.max], 5)
    want = sorted((-int(x[5] @ x[j]), j) for j in range(2000) if j % 3 == 2 and j != 5)[:5]
    assert [(-int(a), int(b)) for a, b in zip(s, ids)] == want and seen[0] < 400


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (3, [0.9, 0.5], 1), (4, [0.5, 0.4], 2), (5, [0.5, 0.4], 2), (6, [-1.0, -1.0], 1),
            (20, [0.0, 0.0], 3), (21, [0.0, 0.0], 3), (22, [0.0, 0.0], 4), (30, [1.0, 2.0, 3.0], 1), (31, [1.0, 2.0, 2.9], 1),
            (32, [0.5, 1.0, 1.5], 2), (40, [1e6, 1.0], 7), (41, [1e6, 2.0], 7), (42, [5e5, 0.1], 8), (50, [1.0], 9)]
    bad = [(None, [1.0, 0.5], 1), (60, None, 1), (70, [1.0, None], 1), (80, [nan, 1.0], 1), (90, [inf, 1.0], 2), (61, [], 1), (62, [1.0, 1.0], None)]
    df = spark.createDataFrame(good + bad + [good[1], good[4]], SCHEMA) \
        .select("*", *[F.lit("x").alias(c) for c in ("id", "q", "dim", "tree", "stretch", "unit", "pos", "rank", "block")])
    want = brute(whole(good), lambda i: i % 10 == 0)
    assert got(hn.mine(df, lambda i: i % 10 == 0)) == want
    assert {r[0] for r in want} >= {0, 10, 20, 30, 40}
    assert hn.mine(df.filter("vec_id < 0"), lambda i: i % 10 == 0).collect() == []
    assert hn.mine(df.filter("vec_id > 50"), lambda i: i % 10 == 0).collect() == []


def test_scores_beyond_64_bits_are_clipped(spark):
    rows = [(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 1), (2, [0.001, 0.0], 2), (3, [1.0, 1.0], 1)]
    out = got(hn.mine(spark.createDataFrame(rows, SCHEMA), lambda i: i == 0))
    assert out == [] or all(r[4] <= 2 ** 63 - 1 for r in out)
