"""Metrics (A5-A12), cohort draws (C1-C5), projections (P*), filters (F*)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airwell import constants as K
from airwell.functions import prepare as P
from airwell.operators import cohort as CO
from airwell.operators import filters as FL
from airwell.operators import metrics as M


def test_auc_exact_matches_pairwise(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(500)]   # many ties
    df = spark.createDataFrame(rows, "y int, s double")
    got = M.auc_exact(df, "y", "s", buckets=16).first()["auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    u = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    assert got == pytest.approx(u / (len(pos) * len(neg)), rel=1e-12)


def test_regression_and_class_metrics(spark):
    rows = [(1.0, 1.5), (2.0, 1.0), (3.0, 3.5), (4.0, 4.0)]
    m = M.regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    y = np.array([r[0] for r in rows]); p = np.array([r[1] for r in rows])
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert m["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert m["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    c = M.class_metrics(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int"), "y", "p").first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 1, 1)
    assert c["accuracy"] == pytest.approx(0.6) and c["precision"] == pytest.approx(2 / 3)


def test_share_prevalence_best(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (False,)], "c boolean")
    sh = {r["c"]: r["share"] for r in M.class_share(df, "c").collect()}
    assert sh == {True: 0.25, False: 0.75} and abs(sum(sh.values()) - 1) < 1e-12
    assert M.prevalence(df, ["c"]).first()["c"] == 0.25
    best = M.best_by(spark.createDataFrame([("a", 0.7), ("b", 0.9), ("c", 0.8)], "model string, auc double"),
                     "model", "auc").first()
    assert best["best_model"] == "b"


def test_pivot(spark):
    long = spark.createDataFrame([(1, "alder_pollen", 0.1), (1, "birch_pollen", 0.2), (2, "alder_pollen", 0.3)],
                                 "v long, pollen string, rmse double")
    w = {r["v"]: (r["alder_pollen"], r["birch_pollen"]) for r in
         M.pivot_metrics(long, "v", "pollen", ["alder_pollen", "birch_pollen"], ["rmse"]).collect()}
    assert w == {1: (0.1, 0.2), 2: (0.3, None)}


def test_cohort_invariants(spark):
    base = spark.range(1, 20001).select(F.col("id").alias("user_id"), (F.col("id") % 5 == 1).alias("family_history_asthma"),
                                       (F.col("id") % 10 == 1).alias("hay_fever"), (18 + F.col("id") % 70).alias("age"))
    c = CO.repair_hay_fever(CO.assign_allergies(base, "user_id"), "user_id")
    c = c.withColumn("dob", CO.birth_date("user_id", "age", 2024)).cache()
    # repeatable
    c2 = CO.assign_allergies(base.repartition(7), "user_id")
    assert c.select("user_id", "eczema").exceptAll(c2.select("user_id", "eczema")).count() == 0
    # every hay-fever case has a pollen allergy
    anyp = F.greatest(*[F.col(n) for n in K.HAY_FEVER_PICK_ORDER])
    assert c.where(F.col("hay_fever") & ~anyp).count() == 0
    # rates near their parameters
    ecz = c.agg(F.avg(F.col("eczema").cast("int"))).first()[0]
    assert abs(ecz - K.PROB_ECZEMA) < 0.02
    # valid dates with the right year
    assert c.where(F.col("dob").isNull() | (F.year("dob") != 2024 - F.col("age"))).count() == 0
    u = base.select(CO.uniform("user_id", "x").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.01


def test_clamp_code(spark):
    df = spark.createDataFrame([(-0.3,), (0.49,), (0.5,), (0.51,), (1.7,), (None,)], "x double")
    assert [r[0] for r in df.select(CO.clamp_code("x")).collect()] == [0, 0, 0, 1, 1, None]


def test_prepare_helpers(spark):
    assert P.snake_case("FamilyHistoryAsthma") == "family_history_asthma"
    assert P.snake_case("PatientID") == "patient_id"
    assert P.snake_case("bmi") == "bmi"
    xs = [0.25, 0.35, 0.45, 1.05, 2.675, -0.25, 12.34]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(P.round_half_even("x", 1)).collect()]
    assert got == [float(np.round(x, 1)) for x in xs]
    t = spark.createDataFrame([("nan",), ("12.5",), ("x",), (None,), ("NaN",)], "s string")
    assert [r[0] for r in t.select(P.number_or_null("s")).collect()] == [None, 12.5, None, None, None]
    assert [r[0] for r in t.select(P.number_or_zero("s")).collect()] == [0.0, 12.5, 0.0, 0.0, 0.0]
    k = spark.createDataFrame([(21001,)], "m long").select(P.site_key("m").alias("k"))
    assert k.select(P.site_id_from_key("k")).first()[0] == 21001
    cat, content = P.split_category(F.lit("Hay Fever: High risk: stay in."))
    r = spark.range(1).select(cat, content).first()
    assert (r[0], r[1]) == ("Hay Fever", "High risk: stay in.")
    ints = spark.createDataFrame([(1, 1, 0, None)], "user_id long, a int, b int, c int")
    assert tuple(P.int_flags_to_bool(ints, ["user_id"]).first()) == (1, True, False, False)


def test_filters(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i)) for i in range(1, 11)], "id long, v double")
    assert FL.drop_null_rows(df).count() == 7
    head, rest = FL.split_first_n(df, 4, ["id"])
    assert sorted(r[0] for r in head.collect()) == [1, 2, 3, 4] and rest.count() == 6
    a, b = FL.hash_split(df, "id", [0.8, 0.2])
    assert a.count() + b.count() == 10 and a.join(b, "id").count() == 0
    assert sorted(r[0] for r in FL.common_keys(df.where("id < 6"), df.where("id > 3"), "id").collect()) == [4, 5]


def test_auc_works_its_rows_out_once(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b
    df = spark.range(200).selectExpr("id % 2 AS y", "CAST(id AS double) AS s").mapInArrow(counted, "y long, s double")
    assert M.auc_exact(df, "y", "s", buckets=16).first()["n_pos"] == 100
    assert met.value == 200
