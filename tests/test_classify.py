"""Pollen classes (R17-R19): inclusive bounds, NULL/NaN/text handling."""

from pyspark.sql import functions as F

from airwell import constants as K
from airwell.functions import classify as C


def py_class(t, x):
    bounds = {k: list(v) + [float("inf")] for k, v in K.POLLEN_CLASS_BOUNDS.items()}
    if t not in bounds:
        return K.UNKNOWN_POLLEN_LABEL
    i = 0
    while x > bounds[t][i]:
        i += 1
    return K.POLLEN_LEVELS[i]


def test_edges(spark):
    rows = []
    for t, (b1, b2, b3) in K.POLLEN_CLASS_BOUNDS.items():
        for x in (0.0, b1, b1 + 1e-9, b2, b2 + 0.5, b3, b3 + 1, 1e9):
            rows.append((t, x))
    rows.append(("Cedar", 3.0))
    df = spark.createDataFrame(rows, "pollen string, c double")
    out = df.select("pollen", "c", C.pollen_class("pollen", "c").alias("lv"), C.class_colour(
        C.pollen_class("pollen", "c")).alias("col")).collect()
    for r in out:
        assert r["lv"] == py_class(r["pollen"], r["c"])
        assert r["col"] == K.LEVEL_COLOURS.get(r["lv"], K.UNKNOWN_COLOUR)


def test_missing_values_count_as_zero(spark):
    df = spark.createDataFrame([("Grass", None), ("Grass", "nan"), ("Grass", "junk"), ("Grass", "6")],
                               "pollen string, c string")
    got = [r[0] for r in df.select(C.pollen_class("pollen", F.col("c"))).collect()]
    assert got == ["Low", "Low", "Low", "Moderate"]


def test_risk_table_long(spark):
    latest = spark.createDataFrame([(1, 20.0, 100.0, 6.0, None, 0.0, 600.0)],
                                   "municipality_id long, alder_pollen double, birch_pollen double, "
                                   "grass_pollen double, mugwort_pollen double, olive_pollen double, "
                                   "ragweed_pollen double")
    t = {r["pollen"]: r["level"] for r in C.risk_table(latest).collect()}
    assert t == {"Alder": "Moderate", "Birch": "High", "Grass": "Moderate", "Mugwort": "Low", "Olive": "Low",
                 "Ragweed": "Very High"}
