import numpy as np
import pytest

from airwell.llm import embed_dedup
from tests.conftest import SF01


def brute(rows, threshold):
    """{id: (links, component)} over rows (id, vector, label)."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None for x in v):
            continue
        x = np.array(v, dtype=float)
        if len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            good.append((i, x / np.linalg.norm(x), label))
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x, a) in enumerate(good):
        for j, y, b in good[:n]:
            if a == b and len(x) == len(y) and x @ y >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def compare(vectors, rows, threshold=0.98):
    got = embed_dedup.near_duplicates(vectors, threshold).collect()
    want = brute(rows, threshold)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id], r
            assert r.kept == (r.component_id == r.vec_id)


def test_whole_table_by_brute_force(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    compare(v, [(r.vec_id, r.embedding, r.label) for r in v.collect()])


def test_large_groups_over_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=24)
    rows = [(i, (centre + rng.normal(size=24) * rng.choice([0.01, 0.12])).tolist(), 1) for i in range(150)]
    rows += [(1000 + i, centre.tolist(), 1) for i in range(40)]
    rows += [(2000 + i, rng.normal(size=24).tolist(), int(i % 3)) for i in range(200)]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows)


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1e-300], 1),
            (13, [-1.0, 0.0], 1), (None, [1.0, 0.0], 3)]
    from pyspark.sql import functions as F
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int") \
        .withColumn("id", F.lit(1)).withColumn("component", F.lit("x")).withColumn("copies", F.lit(0))
    compare(v, rows)
    assert embed_dedup.near_duplicates(v.filter("vec_id < 0")).count() == 0
    repeated = embed_dedup.near_duplicates(v.filter("vec_id = 1").union(v.filter("vec_id = 1"))).collect()
    assert len(repeated) == 2 and {r.component_id for r in repeated} == {1}


@pytest.mark.parametrize("rows", [100, 10_000, 10 ** 9])
def test_passes_grow_with_the_rows(rows):
    passes, bits = embed_dedup.passes_for(rows, 0.98)
    assert 4 <= passes < 1000 and bits <= 62
    assert passes <= embed_dedup.passes_for(rows * 10, 0.98)[0]


def test_labels_in_narrow_cones(spark):
    """Labels whose vectors all have a cosine near c, with isolated pairs above the threshold among them."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = []
    for n, c in enumerate((0.9, 0.95, 0.97)):
        centre = unit(rng.normal(size=64))
        rest = unit(rng.normal(size=(1200, 64)))
        x = unit(np.sqrt(c) * centre + np.sqrt(1 - c) * unit(rest - (rest @ centre)[:, None] * centre))
        side = rng.normal(size=(60, 64))
        side = unit(side - (side * x[:60]).sum(axis=1, keepdims=True) * x[:60])
        near = 0.983 * x[:60] + np.sqrt(1 - 0.983 ** 2) * side
        rows += [(10_000 * n + i, v.tolist(), n) for i, v in enumerate(np.concatenate([x, near]))]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows)


def test_wide_cells_of_many_tiles(spark, monkeypatch):
    """One cell is cut into tiles, and a pair across tiles is found."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32)
    x = centre + 0.2 * rng.normal(size=(400, 32))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, x[:50] + 0.02 * rng.normal(size=(50, 32))]))]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows)


def test_flat_vectors_of_odd_columns():
    import pyarrow as pa
    kind = pa.list_(pa.float64())
    column = pa.array([[9.0], None, [1.0, 2.0], [], [3.0, None], [0.0, -0.0], [float("inf")], [4.0, 5.0, 6.0], [1.0], [2.0]], kind)
    ids = pa.array([0, 1, 2, 3, 4, 5, 6, 7, None, 9], pa.int64())
    labels = pa.array(["a"] * 9 + [None])
    whole = pa.RecordBatch.from_arrays([ids, column, labels], names=["id", "v", "label"])
    for batch, want in ((whole, {0: [9.0], 2: [1.0, 2.0], 7: [4.0, 5.0, 6.0]}), (whole.slice(1, 5), {2: [1.0, 2.0]}), (whole.slice(3, 2), {}),
                        (whole.slice(0, 0), {})):
        out = list(embed_dedup._classes([batch]))[0]
        assert dict(zip(out.column(0).to_pylist(), out.column(3).to_pylist())) == want
        assert out.column(2).to_pylist() == [len(v) for v in want.values()]
    wide = embed_dedup._matrix(pa.chunked_array([column.slice(0, 3), column.slice(7, 1)]))
    assert wide.tolist() == [[9.0, 0, 0], [0, 0, 0], [1.0, 2.0, 0], [4.0, 5.0, 6.0]]
    assert embed_dedup._matrix(pa.chunked_array([], kind)).shape == (0, 0)


def test_float_vectors_are_computed_in_double(spark):
    """Floats near the type's limits, null and odd components, against the same rows as doubles."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in (base + rng.normal(size=16) * 0.06).astype(np.float32)], 1) for i in range(60)]
    rows += [(100, [float(np.float32(3e38))] * 16, 1), (101, [float(np.float32(2.9e38))] * 16, 1),
             (102, [float(np.float32(1e-40))] * 16, 1), (103, [None] * 16, 1), (104, [float("nan")] * 16, 1),
             (105, [float("inf")] * 16, 1), (106, [0.0] * 16, 1), (107, None, 1), (108, [], 1), (109, [1.0] * 16, None)]
    floats = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    compare(floats, rows)
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(embed_dedup.near_duplicates(floats).collect()) == sorted(embed_dedup.near_duplicates(doubles).collect())
