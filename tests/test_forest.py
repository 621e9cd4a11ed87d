"""Forests of many groups at once: against trees grown one by one in plain Python, stored versions, scoring by joins."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from airwell.operators import forest as FO
from airwell.session import list_names, new_work_path


def weight(key, tree):
    u = int(hashlib.md5(f"{key}:bag{tree}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return sum(u >= x for x in FO.BAG_LIMITS)


def plain_tree(rows, names, tree, depth, bins, min_leaf, bootstrap):
    """{node: (feature, threshold, n, value)} of one group; rows are (key, features, target)."""
    lo = [min(r[1][i] for r in rows) for i in range(len(names))]
    hi = [max(r[1][i] for r in rows) for i in range(len(names))]
    edges = [[a + (b - a) * (k / bins) for k in range(1, bins)] for a, b in zip(lo, hi)]
    held = [([sum(x >= e for e in es) for x, es in zip(f, edges)], weight(k, tree) if bootstrap else 1, int(y * 1e6 + 0.5))
            for k, f, y in rows]
    held = [(b, w, w * y) for b, w, y in held if w]
    out = {}

    def grow(node, part, level):
        n, s = sum(w for _, w, _ in part), sum(wy for *_, wy in part)
        best = None
        for i in range(len(names)):
            for b in sorted({p[0][i] for p in part}):
                left = [p for p in part if p[0][i] <= b]
                n0, s0 = sum(p[1] for p in left), sum(p[2] for p in left)
                if n0 < min_leaf or n - n0 < max(1, min_leaf):
                    continue
                gain = float(s0) * float(s0) / n0 + float(s - s0) * float(s - s0) / (n - n0) - float(s) * float(s) / n
                if gain > 1e-12 * (float(s) * float(s) / n) and (best is None or (gain, -i, -b) > best[0]):
                    best = ((gain, -i, -b), i, b)
        split = best if level < depth else None
        out[node] = (names[split[1]], lo[split[1]] + (hi[split[1]] - lo[split[1]]) * ((split[2] + 1) / bins)) if split else (None, None)
        out[node] += (n, s / n / 1e6)
        if split:
            for side in (0, 1):
                grow(2 * node + side, [p for p in part if (p[0][split[1]] > split[2]) == bool(side)], level + 1)
    if held:
        grow(1, held, 0)
    return out


def data(seed=3, n=400):
    rng = random.Random(seed)
    # one group holds a third of all rows, one has a single row, one has equal targets
    group = lambda i: 0 if i % 3 == 0 else 1 + i % 5
    rows = [(f"r{i}", group(i), "a" if i % 2 else "b", float(rng.randrange(0, 40)), rng.randrange(0, 1000) / 8,
             float(rng.randrange(0, 30))) for i in range(n)]
    return rows + [("single", 90, "a", 1.0, 2.0, 7.0)] + [(f"same{i}", 91, "a", float(i), 1.0, 5.0) for i in range(9)]


SCHEMA = "row_key string, g long, kind string, x double, z double, y double"
GROUPS, NAMES = ["g", "kind"], ["x", "z"]


@pytest.mark.parametrize("trees,depth,bins,min_leaf,bootstrap", [(1, 3, 8, 1, False), (4, 4, 5, 3, True)])
def test_against_trees_grown_one_by_one(spark, trees, depth, bins, min_leaf, bootstrap):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {}
    for r in FO.grow(df, GROUPS, NAMES, "y", F.col("row_key"), trees, depth, bins, min_leaf, bootstrap).collect():
        got.setdefault((r.g, r.kind, r.tree), {})[r.node] = (r.feature, r.threshold, r.n, r.value)
        assert (r.left, r.right) == ((2 * r.node, 2 * r.node + 1) if r.feature else (None, None))
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        part = [(r[0], r[3:5], r[5]) for r in rows if (r[1], r[2]) == key]
        for t in range(trees):
            tree = plain_tree(part, NAMES, t, depth, bins, min_leaf, bootstrap)
            if tree:
                want[(*key, t)] = tree
    assert got == want


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame(data(n=40) + [("n1", None, "a", 1.0, 1.0, 1.0), ("n2", 1, "a", None, 1.0, 1.0), ("n3", 1, "a", 1.0, 1.0, None)], SCHEMA)
    clean = df.na.drop()
    grow = lambda d: sorted(FO.grow(d, GROUPS, NAMES, "y", F.col("row_key"), 2).collect(), key=str)
    assert grow(df) == grow(clean) and grow(df.where("g < 0")) == []


def test_jobs_do_not_grow_with_the_groups(spark):
    """The same number of jobs for 3 and for 60 groups."""
    def jobs(groups):
        df = spark.range(600).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % groups).alias("g"), F.lit("a").alias("kind"),
                                     (F.col("id") * 7 % 101).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("z"),
                                     (F.col("id") * 3 % 11).cast("double").alias("y"))
        name = f"forest-{groups}"
        spark.sparkContext.setJobGroup(name, name)
        FO.grow(df, GROUPS, NAMES, "y", F.col("row_key"), 2).count()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext._jsc.clearJobGroup()
        return found
    few, many = jobs(3), jobs(60)
    assert few and many <= few + 2


def test_scoring_walks_the_stored_table(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    path = new_work_path(spark, "t-forest")
    FO.save_models(FO.grow(df.where("g <> 2"), GROUPS, NAMES, "y", F.col("row_key"), trees=3, depth=4), path)
    nodes = FO.load_models(spark, path)
    trees = {}
    for r in nodes.collect():
        trees.setdefault((r.g, r.kind), {}).setdefault(r.tree, {})[r.node] = r
    got = {r.row_key: r.prediction for r in FO.predict(df, nodes, GROUPS, NAMES).collect()}
    assert len(got) == len(rows)
    for key, g, kind, x, z, _ in rows:
        forest = trees.get((g, kind))
        if forest is None:
            assert got[key] is None
            continue
        values = []
        for tree in forest.values():
            node = tree[1]
            while node.feature:
                node = tree[node.left if {"x": x, "z": z}[node.feature] < node.threshold else node.right]
            values.append(node.value)
        assert abs(got[key] - sum(values) / len(values)) < 1e-6


def test_versions(spark):
    path = new_work_path(spark, "t-versions")
    for i in range(5):
        nodes = spark.createDataFrame([(0, 0, 1, None, None, None, None, 1, float(i))],
                                      "g int, tree int, node long, feature string, threshold double, left long, right long, n long, value double")
        assert FO.save_models(nodes, path, keep=2) == f"v={i + 1:08d}"
        assert FO.load_models(spark, path).first().value == float(i)
    assert sorted(n for n in list_names(spark, path) if n.startswith("v=")) == ["v=00000004", "v=00000005"]
    assert FO.load_models(spark, path, "v=00000004").first().value == 3.0


def test_two_steps_shift_the_lags(spark):
    nodes = spark.createDataFrame([(1, 0, 1, "lag_1", 5.0, 2, 3, 9, 0.0), (1, 0, 2, None, None, None, None, 4, 8.0),
                                   (1, 0, 3, "lag_2", 5.0, 6, 7, 5, 0.0), (1, 0, 6, None, None, None, None, 2, 2.5), (1, 0, 7, None, None, None, None, 3, 1.0)],
                                  "g int, tree int, node long, feature string, threshold double, left long, right long, n long, value double")
    rows = spark.createDataFrame([("a", 1, 3.0, 9.0, 9.0, 0.0), ("b", 1, 7.0, 9.0, 9.0, 0.0), ("c", 2, 7.0, 9.0, 9.0, 0.0)],
                                 "row_key string, g int, lag_1 double, lag_2 double, lag_3 double, w double")
    got = {r.row_key: (r.today, r.tomorrow) for r in FO.two_steps(rows, nodes, ["g"], ["lag_1", "lag_2", "lag_3"], ["w"]).collect()}
    # a: today 8 -> lag_1 8, lag_2 3 -> 2.5;  b: today 1 -> lag_1 1 -> 8;  c has no model
    assert got == {"a": (8.0, 2.5), "b": (1.0, 8.0), "c": (None, None)}


def test_rows_of_the_same_bins_are_one_cell(spark):
    """What the trees grow from does not grow with the rows: twice the rows, the same cells of twice the weight."""
    def cells(n):
        df = spark.range(n).select(F.col("id").cast("string").alias("row_key"), F.lit(1).alias("g"), (F.col("id") % 2).cast("double").alias("x"),
                                   (F.col("id") % 3).cast("double").alias("z"), (F.col("id") % 5).cast("double").alias("y"))
        found, ranges = FO.cells_of(df.repartition(5), ["g"], NAMES, "y", F.col("row_key"), trees=2, bootstrap=False)
        assert [(r["_lo"], r["_hi"]) for r in ranges.collect()] == [([0.0, 0.0], [1.0, 2.0])]
        return {(r.tree, tuple(r["_bins"])): (r["_w"], r["_wy"]) for r in found.collect()}
    few, many = cells(300), cells(600)
    assert set(few) == set(many) == {(t, (7 * x, z)) for t in (0, 1) for x in (0, 1) for z in (0, 4, 7)}
    assert many == {k: (2 * w, 2 * wy) for k, (w, wy) in few.items()} and sum(w for w, _ in few.values()) == 600
