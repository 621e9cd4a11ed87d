"""Checked plumbing of the model and scoring pipelines: the parts of training
and forecasting that have one right answer (split membership, feature rows,
rows per fit, the two-step shift), the whole scoring record and the state scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell import constants as K
from airwell.functions import prepare as P
from airwell.functions import scoring as S
from airwell.functions.scoring import fix6
from airwell.operators import features as W
from airwell.operators import filters as FL
from airwell.operators.asof import latest_per_key
from airwell.plans import flagship as FS
from airwell.plans import sqlfrag as Q
from airwell.plans.catalog import register
from airwell.plans.queries import DAILY_SQL, INSIDE_SQL, LATEST_SQL, cte, daily_cover, latest_readings
from airwell.session import materialize
from airwell.sources import files as FI
from airwell.sources import tables as T

LAGS = ["lag_1", "lag_2", "lag_3"]
WEATHER = ["temperature_2m", "precipitation"]


@register("split_membership", lambda: cte(["profiles"]) + """
SELECT user_id, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':split42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 AS train
FROM profiles""")
def split_membership(spark: SparkSession, sf: str) -> DataFrame:
    """F8: the side of the 80/20 split of every user."""
    train, test = FL.hash_split(T.profiles(spark, sf).select("user_id"), "user_id", [0.8, 0.2])
    return train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))


def pollen_features(spark: SparkSession, sf: str) -> DataFrame:
    """W1-W3 for every (valley, pollen): daily series per site, gaps filled,
    three lags and the weather columns.  The pollens are stacked to rows first,
    so one pass over the daily table serves all of them."""
    d = daily_cover(spark, sf)
    d = d.select("municipality_id", "date", *W.feature_columns(d.columns), F.explode(F.array(
        *[F.struct(F.lit(p).alias("pollen"), F.col(p).alias("y")) for p in K.POLLENS])).alias("x")).select(
        "municipality_id", "date", *WEATHER, "x.pollen", "x.y")
    d = d.withColumn("series", F.concat_ws("|", "municipality_id", "pollen"))
    d = W.lags(W.interpolate_fill(d, "series", "date", "y"), "series", "date", "y", 3)
    for i, name in enumerate(LAGS, 1):
        d = d.withColumnRenamed(f"y_lag_{i}", name)
    return d.join(T.sites(spark, sf).select("municipality_id", "valley_id"), "municipality_id")


FEATURES_SQL = ["long AS (" + " UNION ALL ".join(
    f"SELECT municipality_id, date, temperature_2m, precipitation, '{p}' AS pollen, {p} AS v FROM daily" for p in K.POLLENS) + ")",
    """numbered AS (SELECT *, row_number() OVER (PARTITION BY municipality_id, pollen ORDER BY date) AS i FROM long)""",
    """near_ends AS (SELECT *,
      max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY municipality_id, pollen ORDER BY i) AS ip,
      min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY municipality_id, pollen ORDER BY i DESC) AS inn FROM numbered)""",
    """filled AS (SELECT e.*, CASE WHEN e.v IS NOT NULL THEN e.v
        WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v + (b.v - a.v) * CAST(e.i - e.ip AS DOUBLE) / CAST(e.inn - e.ip AS DOUBLE)
        WHEN a.v IS NULL THEN b.v ELSE a.v END AS y
      FROM near_ends e LEFT JOIN numbered a ON a.municipality_id = e.municipality_id AND a.pollen = e.pollen AND a.i = e.ip
      LEFT JOIN numbered b ON b.municipality_id = e.municipality_id AND b.pollen = e.pollen AND b.i = e.inn)""",
    "feats AS (SELECT f.*, s.valley_id, " + ", ".join(
        f"lag(y, {i}) OVER (PARTITION BY f.municipality_id, pollen ORDER BY date) AS lag_{i}" for i in (1, 2, 3))
    + " FROM filled f JOIN sites s USING (municipality_id))"]
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *LAGS, *WEATHER))


@register("forecast_features", lambda: cte(["sites", "readings_hourly"], [DAILY_SQL, *FEATURES_SQL]) + f"""
SELECT municipality_id, valley_id, pollen, date, {', '.join(f'{Q.fix6(c)} AS {c}' for c in ('y', *LAGS, *WEATHER))} FROM feats""")
def forecast_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature rows of all (valley, pollen) models."""
    return pollen_features(spark, sf).select("municipality_id", "valley_id", "pollen", "date",
                                             *[fix6(c).alias(c) for c in ("y", *LAGS, *WEATHER)])


@register("forecast_fit_rows", lambda: cte(["sites", "readings_hourly"], [DAILY_SQL, *FEATURES_SQL]) + f"""
SELECT valley_id, pollen, count(*) AS n FROM feats WHERE {COMPLETE} GROUP BY ALL""")
def forecast_fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Complete rows that each (valley, pollen) fit is given."""
    full = FL.drop_null_rows(pollen_features(spark, sf), ["y", *LAGS, *WEATHER])
    return full.groupBy("valley_id", "pollen").agg(F.count(F.lit(1)).alias("n"))


_MEAN = "((a * 0.5e0 + b * 0.3e0) + c * 0.2e0)"


@register("two_step_shift", lambda: cte(["sites", "readings_hourly"], [DAILY_SQL, *FEATURES_SQL]) + f"""
, newest AS (SELECT * FROM feats WHERE {COMPLETE}
  QUALIFY row_number() OVER (PARTITION BY municipality_id, pollen ORDER BY date DESC) = 1),
first_step AS (SELECT *, {_MEAN.replace('a ', 'lag_1 ').replace('b ', 'lag_2 ').replace('c ', 'lag_3 ')} AS today FROM newest)
SELECT municipality_id, pollen, date, {Q.fix6('today')} AS today,
  {Q.fix6(_MEAN.replace('a ', 'today ').replace('b ', 'lag_1 ').replace('c ', 'lag_2 '))} AS tomorrow FROM first_step""")
def two_step_shift(spark: SparkSession, sf: str) -> DataFrame:
    """F7 + W4 on a fixed linear rule in place of a model: today's value from
    the lags of the newest complete day, then tomorrow's from the shifted lags."""
    def rule():
        return F.col("lag_1") * F.lit(0.5) + F.col("lag_2") * F.lit(0.3) + F.col("lag_3") * F.lit(0.2)

    full = FL.drop_null_rows(pollen_features(spark, sf), ["y", *LAGS, *WEATHER])
    newest = latest_per_key(full, ["municipality_id", "pollen"], ["date"])
    t = newest.withColumn("today", rule()).withColumns(W.shift_lags(LAGS, F.col("today"))).withColumn("tomorrow", rule())
    return t.select("municipality_id", "pollen", "date", fix6("today").alias("today"), fix6("tomorrow").alias("tomorrow"))


@register("scoring_record", lambda: FS.enriched_sql_prefix() + "SELECT user_id, window_end, pollen, score, pei, final_score FROM ("
          + " UNION ALL ".join(f"SELECT user_id, window_end, '{p}' AS pollen, {Q.pollen_score(p)} AS score, {Q.pei()} AS pei, "
                               f"{Q.risk_score()} AS final_score FROM full_rows" for p in K.POLLENS) + ") t")
def scoring_record(spark: SparkSession, sf: str) -> DataFrame:
    """The scoring record with its per-pollen map, one row per entry."""
    s = S.with_scores(FS.enriched_windows(spark, sf), with_list=False).withColumn("scores", S.pollen_scores_map())
    return s.select("user_id", "window_end", F.explode("scores").alias("pollen", "score"), "pei", "final_score")


@register("state_scan", lambda: cte(["readings"], [LATEST_SQL]) + """
SELECT 'municipality:' || municipality_id AS key, municipality_id, ts, pm10 FROM latest""")
def state_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The stored latest-state table, scanned by key prefix."""
    state = latest_readings(spark, sf).withColumn("key", P.site_key("municipality_id"))
    stored = materialize(state, "latest-state")
    return FI.scan_latest_state(stored).select("key", "municipality_id", "ts", "pm10")


@register("valley_of_sites", lambda: cte(["sites", "valleys"], [
    INSIDE_SQL.replace("SELECT DISTINCT lat, lng FROM vitals", "SELECT DISTINCT latitude AS lat, longitude AS lng FROM sites")]) + """
SELECT i.lat, i.lng, i.valley_id, v.valley, 'contains' AS method FROM inside i JOIN valleys v USING (valley_id)
UNION ALL
SELECT lat, lng, valley_id, valley, 'centroid' AS method FROM (
  SELECT p.lat, p.lng, v.valley_id, v.valley,
         row_number() OVER (PARTITION BY p.lat, p.lng ORDER BY
           round(sqrt(pow(p.lat - (v.lat_lo + v.lat_hi) / 2, 2) + pow(p.lng - (v.lng_lo + v.lng_hi) / 2, 2)), 9),
           v.valley_id) AS rn
  FROM (SELECT DISTINCT latitude AS lat, longitude AS lng FROM sites
        WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lat = latitude AND i.lng = longitude)) p, valleys v) t
WHERE rn = 1""")
def valley_of_sites(spark: SparkSession, sf: str) -> DataFrame:
    """M11's valley choice for every site position: polygon, else centroid."""
    from airwell.operators.spatial import valley_for_points
    s = T.sites(spark, sf).select(F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return valley_for_points(s, T.valleys(spark, sf)).select("lat", "lng", "valley_id", "valley", "method")

