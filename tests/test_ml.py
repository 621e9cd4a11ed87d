"""MLlib pieces on small data: encoding, expansion, forests, grid search,
per-group fits with save/load, two-step forecast lag shift."""

import pytest
from pyspark.sql import functions as F

from airwell.operators import features as W
from airwell.operators import ml as ML
from airwell.session import new_work_path


def test_label_encode_alphabetical(spark):
    df = spark.createDataFrame([("view",), ("click",), ("error",), ("click",)], "t string")
    got = {r["t"]: r["i"] for r in ML.label_encode(df, "t", "i").collect()}
    assert got == {"click": 0.0, "error": 1.0, "view": 2.0}


def test_poly2_order(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k long, x double, y double")
    r = ML.poly2(df, ["x", "y"], "k").first()
    assert [r[f"poly_{i}"] for i in range(5)] == [2.0, 4.0, 3.0, 6.0, 9.0]


def _data(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("user_id"), (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 17) > 8).cast("double").alias("label"))


def test_classifier_and_grid(spark):
    d = _data(spark)
    m = ML.train_classifier(d, ["a", "b"], "label", "rf", num_trees=5, max_depth=4)
    s = ML.score(m, d, ["user_id", "label"])
    acc = s.agg(F.avg((F.col("prediction").cast("double") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.95
    best = ML.tune_forest(d, ["a", "b"], "label", grid={"numTrees": [3, 5], "maxDepth": [2, 4]}, folds=2)
    assert best.stages[-1].getNumTrees in (3, 5)
    g = ML.train_classifier(d, ["a", "b"], "label", "gbt", num_trees=5, max_depth=3)
    assert ML.score(g, d, ["user_id"]).count() == 400


def test_group_forests_save_load(spark):
    d = _data(spark).withColumn("g", F.col("user_id") % 3).withColumn("y", F.col("a") * 2.0)
    path = new_work_path(spark, "t-models")
    out = ML.train_forests(d, [(0,), (1,), (2,)], ["g"], lambda g: "y", lambda g: ["a", "b"], path,
                           num_trees=5, max_depth=5, threads=3)
    assert len(out) == 3 and all(o[1] for o in out)
    m = ML.load_forest(out[0][1])
    assert m.getNumTrees == 5


def test_shift_lags(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 9.0)], "l1 double, l2 double, l3 double, today double")
    r = df.withColumns(W.shift_lags(["l1", "l2", "l3"], F.col("today"))).first()
    assert (r["l1"], r["l2"], r["l3"]) == (9.0, 1.0, 2.0)


def test_memory_sink(spark):
    from airwell.sources import messages as MS
    from airwell.streaming import pipelines as SP
    base = new_work_path(spark, "t-mem")
    spark.createDataFrame([("1", '{"reading_id": 1, "municipality_id": 2, "ts": 0.0}')], "key string, value string") \
        .write.json(f"{base}/topic")
    q = SP.to_memory(SP.parse_readings(MS.file_stream(spark, f"{base}/topic")), "mem_readings")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM mem_readings").first()[0] == 1


def test_fits_are_cut_into_tasks(spark, monkeypatch):
    monkeypatch.setattr(ML, "TASK_ROWS", 100)
    d = spark.range(950).select(F.col("id").alias("user_id"), (F.col("id") % 9).cast("double").alias("a")).coalesce(1)
    cut = ML.spread(d)
    assert cut.rdd.getNumPartitions() == 10 and cut.count() == 950
    assert max(len(p) for p in cut.rdd.glom().collect()) < 200
    assert cut.rdd.glom().collect() == ML.spread(d.repartition(7)).rdd.glom().collect()     # however the rows lay
    assert ML.spread(d.limit(100)).rdd.getNumPartitions() == 1
