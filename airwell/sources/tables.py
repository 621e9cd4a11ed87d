"""Driver tables and the domain views derived from them.

The driver ships TPC-H-like parquet tables.  The domain (sites, hourly
readings, user profiles, wearable vitals, valley boxes) is derived from them
by pure projections, so every query reads the whole input and its work grows
with it.  Only the columns a view needs are read (parquet column pruning), and
filters written on top of a view reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# epoch seconds of 2023-12-25 00:00:00 UTC, the first reading hour
READINGS_EPOCH = 1703462400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(x: float) -> Column:
    return F.lit(float(x))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring sites (municipalities): id, name, valley id, lat/lng."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("municipality_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("valley_id"),
        (_d(45.7) + ((k * 37) % 131) * _d(1e-2)).alias("latitude"),
        (_d(10.4) + ((k * 53) % 197) * _d(1e-2)).alias("longitude"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly pollen / air-quality / weather readings per site."""
    li = table(spark, sf_dir, "lineitem")
    ok, qty, disc, tax, price = (F.col(c) for c in
                                 ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return li.select(
        ((ok * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("reading_id"),
        F.col("l_suppkey").alias("municipality_id"),
        F.timestamp_seconds(F.lit(READINGS_EPOCH) + (ok % 864) * 3600).alias("ts"),
        (qty * _d(0.5)).alias("alder_pollen"),
        (disc * _d(1e3)).alias("birch_pollen"),
        (tax * _d(1e3)).alias("grass_pollen"),
        F.when(ok % 7 < 2, F.lit(None).cast("double")).otherwise(qty).alias("mugwort_pollen"),
        (disc * _d(1e2)).alias("olive_pollen"),
        (tax * _d(1e2)).alias("ragweed_pollen"),
        (qty * _d(2.0)).alias("european_aqi"),
        (price / _d(1e3)).alias("pm10"),
        (price / _d(2e3)).alias("pm2_5"),
        (tax * _d(5e2)).alias("nitrogen_dioxide"),
        (disc * _d(2e2)).alias("sulphur_dioxide"),
        (qty * _d(1e1)).alias("carbon_monoxide"),
        (price / _d(1e3) + _d(2e1)).alias("ozone"),
        (qty - _d(1e1)).alias("temperature_2m"),
        (tax * _d(1e1)).alias("precipitation"),
    )


PROFILE_FLAGS = ["gender", "current_smoker", "family_history_asthma",
                 "alder_pollen_allergy", "birch_pollen_allergy", "grass_pollen_allergy",
                 "mugwort_pollen_allergy", "olive_pollen_allergy", "ragweed_pollen_allergy",
                 "asthma_allergy", "hay_fever", "eczema", "cad"]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User health profiles: demographics and boolean condition flags."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("user_id"),
        (k % 2 == 0).alias("gender"),
        (F.lit(18) + k % 70).alias("age"),
        (_d(18.0) + (k % 170) / _d(1e1)).alias("bmi"),
        (k % 13 == 0).alias("current_smoker"),
        (k % 5 == 1).alias("family_history_asthma"),
        (k % 3 == 0).alias("alder_pollen_allergy"),
        (k % 4 == 0).alias("birch_pollen_allergy"),
        (k % 5 == 0).alias("grass_pollen_allergy"),
        (k % 6 == 0).alias("mugwort_pollen_allergy"),
        (k % 7 == 0).alias("olive_pollen_allergy"),
        (k % 8 == 0).alias("ragweed_pollen_allergy"),
        (k % 9 == 1).alias("asthma_allergy"),
        (k % 10 == 1).alias("hay_fever"),
        (k % 11 == 0).alias("eczema"),
        (k % 12 == 0).alias("cad"),
    )


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wearable vitals, one row per event, with the wearer's position."""
    e = table(spark, sf_dir, "events")
    v, u = F.col("value"), F.col("user_id")
    hr = _d(45.0) + v % _d(1e2)
    return e.select(
        F.col("event_id"),
        u.alias("user_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        hr.alias("heart_rate"),
        (_d(1e3) / hr).alias("ibi"),
        (_d(1.0) + v % _d(1e1)).alias("eda"),
        (_d(33.0) + v % _d(6.0)).alias("skin_temp"),
        ((v % _d(1e2)) / _d(1e2)).alias("activity_level"),
        (_d(45.75) + ((u * 29) % 125) * _d(1e-2)).alias("lat"),
        (_d(10.45) + ((u * 41) % 189) * _d(1e-2)).alias("lng"),
    )


def valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valley boxes: id, name and a closed ring of (lat, lng) corners."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    lat_lo = _d(45.7) + (k % 5) * _d(0.28)
    lat_hi = _d(45.7) + (k % 5) * _d(0.28) + _d(0.2)
    lng_lo = _d(10.4) + F.floor(k / _d(5.0)) * _d(0.4)
    lng_hi = _d(10.4) + F.floor(k / _d(5.0)) * _d(0.4) + _d(0.3)
    ring = F.array(
        F.array(lat_lo, lng_lo), F.array(lat_lo, lng_hi), F.array(lat_hi, lng_hi),
        F.array(lat_hi, lng_lo), F.array(lat_lo, lng_lo),
    )
    return n.select(k.alias("valley_id"), F.col("n_name").alias("valley"),
                    lat_lo.alias("lat_lo"), lat_hi.alias("lat_hi"),
                    lng_lo.cast("double").alias("lng_lo"), lng_hi.cast("double").alias("lng_hi"),
                    ring.alias("ring"))
