"""Grid search over folds (M4): forests that have not seen a row score it,
smaller parameters are parts of larger fits, the choice."""

from pyspark.sql import functions as F

from airwell.operators import forest as FO
from airwell.operators import grid as G

GRID = {"trees": [1, 2], "depth": [1, 2], "min_leaf": [1, 30]}


def data(spark, n=300):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"),
                                 (((F.col("id") % 17) > 8) & ((F.col("id") % 5) > 1)).cast("double").alias("y"))


def test_folds_are_a_partition_of_the_keys(spark):
    folds = data(spark).select(G.fold_of("k", 4).alias("f")).groupBy("f").count().collect()
    assert {r["f"] for r in folds} == {0, 1, 2, 3} and sum(r["count"] for r in folds) == 300
    again = data(spark).repartition(7).where(G.fold_of("k", 4) == 2).count()
    assert again == next(r["count"] for r in folds if r["f"] == 2)


def test_scores_equal_one_fit_per_combination(spark):
    d = data(spark)
    nodes = G.grow_folds(d, "k", ["a", "b"], "y", 3, GRID)
    scored = G.score_folds(d, nodes, "k", ["a", "b"], "y", 3, GRID)
    assert scored.count() == 300 * 8
    for trees, depth, leaf, fold in ((1, 1, 1, 0), (2, 2, 30, 1), (2, 1, 30, 2)):
        own = G.fold_of("k", 3) == fold
        alone = FO.grow(d.where(~own).withColumn("m", F.lit(1)), ["m"], ["a", "b"], "y", F.col("k"), trees=trees, depth=depth, min_leaf=leaf)
        want = FO.predict(d.where(own).withColumn("m", F.lit(1)).withColumn("row_key", F.col("k")), alone, ["m"], ["a", "b"])
        got = scored.where((F.col("trees") == trees) & (F.col("depth") == depth) & (F.col("min_leaf") == leaf) & (F.col("fold") == fold))
        pairs = got.join(want.select("k", "prediction"), "k").select("score", "prediction").collect()
        assert len(pairs) == d.where(own).count() > 50
        assert all(abs(r["score"] / 1e6 - r["prediction"]) < 2e-6 for r in pairs)
        assert alone.agg(F.min("n")).first()[0] >= leaf


def test_choice_and_final_fit(spark):
    d = data(spark)
    choice = G.choose(G.search(d, "k", ["a", "b"], "y", GRID, 3))
    rows = sorted(choice.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, 9)) and [r["chosen"] for r in rows] == [True] + [False] * 7
    assert rows[0]["mean_auc"] == max(r["mean_auc"] for r in rows) and rows[0]["depth"] == 2 and rows[0]["folds"] == 3
    nodes = G.fit_chosen(d, "k", ["a", "b"], "y", choice)
    assert nodes.select("tree").distinct().count() == rows[0]["trees"]


def test_one_class_and_nulls(spark):
    d = data(spark, 60).withColumn("y", F.lit(0.0)).withColumn("a", F.when(F.col("b") > 0, F.col("a")))
    per_fold = G.search(d, "k", ["a", "b"], "y", GRID, 3)
    got = per_fold.collect()
    assert len(got) == 8 * 3 and all(r["auc"] is None and r["n_pos"] == 0 for r in got)
    assert sum(r["n_neg"] for r in got) == 8 * 48
    assert G.choose(per_fold).where("chosen").first()["trees"] == 1


def test_rows_of_one_task_are_spread(spark, monkeypatch):
    seen = []
    plain = FO.cells_of
    monkeypatch.setattr(FO, "cells_of", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or plain(rows, *a))
    d = data(spark, 60_000).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert G.search(d, "k", ["a", "b"], "y", {"trees": [1], "depth": [1], "min_leaf": [1]}, 3).count() == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0] > 1
