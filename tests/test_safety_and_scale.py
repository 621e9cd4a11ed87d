"""NaN and NULL safety of the scores, literal constants, linear interpolation,
plans without a single-task total, and the shared-folder rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from airwell import constants as K
from airwell.functions import scoring as S
from airwell.operators import features as W
from airwell.operators import metrics as M
from airwell.sinks.tables import read_history, write_history


def _row(spark, pm10=10.0, **flags):
    base = {p: 0.01 for p in K.POLLENS} | {"european_aqi": 1.0, "pm10": pm10, "pm2_5": 1.0, "nitrogen_dioxide": 1.0,
                                          "sulphur_dioxide": 1.0, "carbon_monoxide": 1.0, "ozone": 1.0}
    flag = {f"{p}_allergy": False for p in K.POLLENS} | {f: False for f, _ in K.CONDITION_FACTORS}
    flag.update(flags)
    schema = ", ".join(f"{c} double" for c in base) + ", " + ", ".join(f"{c} boolean" for c in flag)
    return spark.createDataFrame([tuple(base.values()) + tuple(flag.values())], schema)


def test_nan_reading_gives_no_score_and_no_advice(spark):
    r = _row(spark, float("nan")).select(S.ceri().alias("c"), S.risk_score().alias("r"), S.advice_general(S.risk_score()).alias("a")).first()
    assert (r.c, r.r, r.a) == (None, None, None)
    ok = _row(spark).select(S.ceri().alias("c"), S.risk_score().alias("r"), S.advice_general(S.risk_score()).alias("a")).first()
    assert 0 < ok.c < 0.1 and 0 < ok.r < 0.3 and ok.a == "General: You might experience mild symptoms."


def test_null_flag_counts_as_not_set(spark):
    plain = _row(spark).select(S.risk_score()).first()[0]
    assert _row(spark, hay_fever=None, birch_pollen_allergy=None).select(S.risk_score()).first()[0] == plain
    nothing = {f"{p}_allergy": None for p in K.POLLENS} | {f: None for f, _ in K.CONDITION_FACTORS}
    assert _row(spark, **nothing).select(S.risk_score()).first()[0] is None      # no profile at all


def test_constants_are_the_fixed_values():
    assert K.POLLEN_WEIGHTS == {"alder_pollen": 1.0, "birch_pollen": 1.5, "grass_pollen": 1.2, "mugwort_pollen": 1.3,
                                "olive_pollen": 1.0, "ragweed_pollen": 1.4}
    assert K.RISK_WEIGHTS == {"pollen": 1.0, "aqi": 1.5, "pm10": 1.0, "pm2_5": 1.3, "ozone": 1.2}
    assert K.CONDITION_FACTORS == [("asthma_allergy", 1.3), ("hay_fever", 1.1), ("eczema", 1.05), ("cad", 1.2)]
    assert (K.ALLERGY_FACTOR, K.RISK_DIVISOR, K.CERI_DIVISOR, K.OZONE_REFERENCE, K.PMHI_WEIGHTS) == (1.5, 15.0, 2000.0, 120.0, (0.4, 0.6))
    assert (K.GENERAL_CUTS, K.CONDITION_CUTS) == ((0.3, 0.7), (0.5, 0.8))


def test_interpolation_of_one_long_series_is_linear(spark):
    n = 80_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"),
                               F.when(F.col("id") % 5 == 2, F.col("id").cast("double")).alias("v"))
    start = time.time()
    got = W.interpolate_fill(df, "k", "t", "v", out="f").agg(F.count("f").alias("n"), F.sum("f").alias("s")).first()
    assert time.time() - start < 30
    inner = sum(range(2, n - 2))                    # interpolation restores the line between the ends
    last = max(i for i in range(n) if i % 5 == 2)
    want = 2 + 2 + sum(range(2, last + 1)) + last * (n - 1 - last)
    assert got.n == n and abs(got.s - want) < 1e-3 and inner > 0


def test_class_share_has_no_single_partition_window(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(10)], "c int")
    share = M.class_share(df, "c")
    assert "Window" not in share._jdf.queryExecution().toString()
    assert {r.c: (r.n, round(r.share, 6)) for r in share.collect()} == {0: (4, 0.4), 1: (3, 0.3), 2: (3, 0.3)}


def test_r2_of_values_far_from_zero(spark):
    rng = random.Random(1)
    rows = [(1e9 + rng.random(), 1e9 + 0.5) for _ in range(1000)]
    r2 = M.regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first().r2
    mean = sum(y for y, _ in rows) / len(rows)
    want = 1 - sum((y - p) ** 2 for y, p in rows) / sum((y - mean) ** 2 for y, _ in rows)
    assert abs(r2 - want) < 1e-3


def test_a_hot_site_is_several_history_files(spark):
    df = spark.range(20_000).select(F.lit(7).alias("municipality_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts")) \
        .withColumn("year", F.year("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        back = read_history(spark, write_history(spark, df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert back.count() == 20_000
    assert back.select(F.input_file_name()).distinct().count() > 1


def test_shared_folder_must_be_named_off_local_mode(spark, monkeypatch):
    from airwell import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
