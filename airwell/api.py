"""Public entry points (X1, X2): the per-row scoring function of the original
becomes DataFrame -> DataFrame transformations over joins and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.functions import scoring as S
from airwell.operators.asof import asof_join
from airwell.operators.joins import enrich_profile
from airwell.operators.spatial import nearest_site

SCORED_COLUMNS = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen", "olive_pollen", "ragweed_pollen",
                  "european_aqi", "pm10", "pm2_5", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide", "ozone"]


def enrich(windows: DataFrame, sites: DataFrame, readings: DataFrame, profiles: DataFrame,
           bucket_seconds: int = 86400, levels=None) -> DataFrame:
    """J4 + J5 + J6: nearest site, as-of reading at the window end, profile.

    ``windows``: user_id, window_end, lat, lng, avg_* columns.
    ``readings``: municipality_id, ts, reading_id, pm10 and the scored values
    (may hold several rows per site and time; the greatest (reading_id, pm10)
    wins)."""
    near = nearest_site(windows.select("lat", "lng"), sites, levels=levels)
    w = windows.join(near, ["lat", "lng"], "left")
    env = readings.select("municipality_id", "reading_id", F.col("ts").alias("reading_ts"),
                          *[c for c in SCORED_COLUMNS])
    w = asof_join(w, env, "municipality_id", "window_end", "reading_ts", bucket_seconds=bucket_seconds,
                  tie_order=["reading_id", "pm10"])
    return enrich_profile(w, profiles)


def score(enriched: DataFrame, weights: S.Weights = S.DEFAULT_WEIGHTS) -> DataFrame:
    """Every index, the personal score and the ordered advice list."""
    return S.with_scores(enriched, weights, with_list=True)


def recommend(windows: DataFrame, sites: DataFrame, readings: DataFrame, profiles: DataFrame,
              weights: S.Weights = S.DEFAULT_WEIGHTS, levels=None) -> DataFrame:
    """X1 + X2: (window, recommendations, count) per user window.  ``levels``
    fixes the nearest-site grid (computed once for a stream's static sites)."""
    s = score(enrich(windows, sites, readings, profiles, levels=levels), weights)
    return s.select("user_id", "window_start", "window_end", "n_events", "municipality_id", "final_score",
                    "recommendations")
