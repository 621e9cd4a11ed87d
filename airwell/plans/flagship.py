"""Flagship: windowed vitals -> nearest site -> as-of reading -> profile ->
exposure indexes and personal risk (A1, J4, J5, J6, R1-R8).

One Catalyst plan from the parquet scans to the result: the window is a hash
aggregate, the nearest site is a grid equi-join on distinct positions, the
as-of lookup is a bucketed equi-join, and every score is a JVM expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.functions import scoring as S
from airwell.operators.asof import asof_join, latest_per_key
from airwell.operators.spatial import nearest_site
from airwell.operators.windows import VITAL_COLUMNS, vitals_window
from airwell.plans import sqlfrag as Q
from airwell.plans.oracle_views import with_views
from airwell.session import materialize
from airwell.sources import tables as T


# reading columns the scores read
SCORED_COLUMNS = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen", "olive_pollen", "ragweed_pollen",
                  "european_aqi", "pm10", "pm2_5", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide", "ozone"]


def hourly_readings(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    """Readings reduced to one per (site, hour): greatest (reading_id, pm10).  With ``cols`` a row holds these
    only: what is chosen by its order passes the sort and the shuffle whole, also columns that nobody reads."""
    r = T.readings(spark, sf_dir)
    if cols is not None:
        r = r.select(*dict.fromkeys(["municipality_id", "ts", "reading_id", "pm10", *cols]))
    return latest_per_key(r, ["municipality_id", "ts"], ["reading_id", "pm10"])


def enriched_windows(spark: SparkSession, sf_dir: str, size: str = "1 minute") -> DataFrame:
    """Vitals windows with nearest site, as-of reading and profile columns."""
    win = vitals_window(T.vitals(spark, sf_dir), size)
    near = nearest_site(win.select("lat", "lng"), T.sites(spark, sf_dir))
    # The windows feed the as-of lookup at three points; write them once to
    # the shared folder instead of re-aggregating the raw events each time.
    win = materialize(win.join(near, ["lat", "lng"], "left"), "vitals-windows")
    env = T.readings(spark, sf_dir).select("municipality_id", "reading_id", F.col("ts").alias("reading_ts"),
                                           *SCORED_COLUMNS)
    win = asof_join(win, env, "municipality_id", "window_end", "reading_ts", tie_order=["reading_id", "pm10"])
    return win.join(T.profiles(spark, sf_dir), "user_id", "left")


def flagship_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.with_scores(enriched_windows(spark, sf_dir), with_list=False)
    return df.select(
        "user_id", "window_start", "window_end", "n_events", "municipality_id",
        S.fix6("distance_km").alias("distance_km"), "reading_id", "reading_ts",
        "pei", "aqii", "opii", "pmhi", "ceri", "final_score", S.advice_general("final_score").alias("advice"))


def win_sql(size_minutes: int = 1) -> str:
    avgs = ", ".join(f"avg({c}) AS avg_{c}" for c in VITAL_COLUMNS)
    return f"""win AS (
  SELECT user_id, time_bucket(INTERVAL {size_minutes} MINUTE, ts) AS window_start,
         time_bucket(INTERVAL {size_minutes} MINUTE, ts) + INTERVAL {size_minutes} MINUTE AS window_end,
         arg_min(lat, (ts, event_id)) AS lat, arg_min(lng, (ts, event_id)) AS lng, {avgs}, count(*) AS n_events
  FROM vitals GROUP BY ALL)"""


def near_sql(points: str = "win") -> str:
    d = Q.haversine("p.lat", "p.lng", "s.latitude", "s.longitude")
    return f"""near AS (
  SELECT lat, lng, municipality_id, distance_km FROM (
    SELECT p.lat, p.lng, s.municipality_id, {d} AS distance_km,
           row_number() OVER (PARTITION BY p.lat, p.lng ORDER BY round({d}, 9), s.municipality_id) AS rn
    FROM (SELECT DISTINCT lat, lng FROM {points}) p, sites s) t
  WHERE rn = 1 AND distance_km <= 10000.0)"""


ENV_SQL = """env AS (
  SELECT w.*, near.municipality_id, near.distance_km FROM win w LEFT JOIN near USING (lat, lng)),
envr AS (
  SELECT e.*, r.reading_id, r.ts AS reading_ts, r.alder_pollen, r.birch_pollen, r.grass_pollen, r.mugwort_pollen,
         r.olive_pollen, r.ragweed_pollen, r.european_aqi, r.pm10, r.pm2_5, r.nitrogen_dioxide, r.sulphur_dioxide,
         r.carbon_monoxide, r.ozone, r.temperature_2m, r.precipitation
  FROM env e ASOF LEFT JOIN readings_hourly r
    ON e.municipality_id = r.municipality_id AND e.window_end >= r.ts),
full_rows AS (SELECT * FROM envr LEFT JOIN profiles USING (user_id))"""


def enriched_sql_prefix(size_minutes: int = 1) -> str:
    return (with_views("sites", "readings_hourly", "profiles", "vitals").rstrip()
            + ",\n" + win_sql(size_minutes) + ",\n" + near_sql() + ",\n" + ENV_SQL + "\n")


def flagship_sql() -> str:
    return enriched_sql_prefix() + f"""
SELECT user_id, window_start, window_end, n_events, municipality_id, {Q.fix6('distance_km')} AS distance_km,
       reading_id, reading_ts, {Q.pei()} AS pei, {Q.aqii()} AS aqii, {Q.opii()} AS opii,
       {Q.pmhi()} AS pmhi, {Q.ceri()} AS ceri, {Q.risk_score()} AS final_score,
       {Q.advice_general(Q.risk_score())} AS advice
FROM full_rows"""
