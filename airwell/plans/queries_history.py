"""Bucketed history (K6, U3, S8): newest rows without a shuffle, one site by pruned buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.functions import prepare as P
from airwell.plans.catalog import register
from airwell.plans.queries import cte
from airwell.sinks.history import BucketedHistory, history_of_site, newest_of_year, write_bucketed_history
from airwell.sources import tables as T

YEAR = 2024


def _written(spark: SparkSession, sf: str) -> BucketedHistory:
    rows = T.readings(spark, sf).select("municipality_id", "ts", "reading_id", "pm10").withColumn("year", P.year_of("ts"))
    return write_bucketed_history(spark, rows)


@register("history_bucketed_newest", lambda: cte(["readings"]) + """
SELECT * FROM (SELECT municipality_id, CAST(year(ts) AS INTEGER) AS year, ts, reading_id, pm10,
    CAST(row_number() OVER (PARTITION BY municipality_id, year(ts) ORDER BY ts DESC, reading_id DESC, pm10 DESC) AS INTEGER) AS rank
  FROM readings) t WHERE rank <= 5""")
def history_bucketed_newest(spark: SparkSession, sf: str) -> DataFrame:
    """K6 + U3: the five newest readings of each site and year (a top-k report), from the bucketed table."""
    return newest_of_year(spark, _written(spark, sf), 5, ["ts", "reading_id", "pm10"]).select(
        "municipality_id", "year", "ts", "reading_id", "pm10", "rank")


@register("history_busiest_site", lambda: cte(["readings"]) + f"""
SELECT municipality_id, CAST(year(ts) AS INTEGER) AS year, ts, reading_id, pm10 FROM readings
WHERE year(ts) = {YEAR} AND municipality_id = (SELECT municipality_id FROM readings WHERE year(ts) = {YEAR}
  GROUP BY municipality_id ORDER BY count(*) DESC, municipality_id LIMIT 1)""")
def history_busiest_site(spark: SparkSession, sf: str) -> DataFrame:
    """K6 + S8: the year's readings of the site that has most of them, looked up by its key."""
    history = _written(spark, sf)
    counts = spark.table(history.table).where(F.col("year") == YEAR).groupBy("municipality_id").count()
    busiest = counts.agg(F.max_by("municipality_id", F.struct("count", -F.col("municipality_id")))).first()[0]
    return history_of_site(spark, history, busiest, YEAR).select("municipality_id", "year", "ts", "reading_id", "pm10")
