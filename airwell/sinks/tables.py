"""Batch sinks (K5, K6, K9, K10) and the latest-state merge (K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.operators.asof import latest_per_key
from airwell.session import new_work_path


def write_csv(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> str:
    """K5: CSV with header."""
    path = path or new_work_path(spark, name)
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None,
                  path: str | None = None) -> str:
    path = path or new_work_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_history(spark: SparkSession, readings: DataFrame, path: str | None = None,
                  key: str = "municipality_id", ts: str = "ts") -> str:
    """K6: history laid out like a (site, year) partition key with newest
    first: one folder per year, rows clustered by site and sorted by time
    descending inside each file.  Rows are range-partitioned on (year, site,
    time): a reader filtering on year prunes folders, and a site with a large
    share of all rows is cut by time into several tasks and files."""
    path = path or new_work_path(spark, "history")
    (readings.repartitionByRange("year", key, ts)
             .sortWithinPartitions("year", key, F.col(ts).desc())
             .write.mode("overwrite").partitionBy("year").parquet(path))
    return path


def read_history(spark: SparkSession, path: str, years: list[int] | None = None,
                 sites: list[int] | None = None, key: str = "municipality_id") -> DataFrame:
    h = spark.read.parquet(path)
    if years:
        h = h.where(F.col("year").isin(years))   # partition filter
    if sites:
        h = h.where(F.col(key).isin(sites))      # pushed to the parquet scan
    return h


def write_partitioned_by_valley(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> str:
    """K9: one folder per valley (replaces moving files into folders); rows
    are rebalanced by valley first, so each folder receives few files and a
    large valley is split over several tasks."""
    return write_parquet(spark, df.hint("rebalance", "valley"), name, ["valley"], path)


def merge_latest(snapshot: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """K2 merge step: snapshot U batch reduced to the newest row per key."""
    both = batch if snapshot is None else snapshot.unionByName(batch, allowMissingColumns=True)
    return latest_per_key(both, [key], order)
