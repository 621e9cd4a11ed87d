"""Tumbling-window vitals (A1, T2) for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VITAL_COLUMNS = ["heart_rate", "ibi", "eda", "skin_temp", "activity_level"]


def vitals_window(vitals: DataFrame, size: str = "1 minute", per_user: bool = True,
                  ts: str = "ts", keep_struct: bool = False) -> DataFrame:
    """Mean vitals per (user, tumbling window).

    The position is the first one in event time (``min_by`` on the event
    time), so the result does not depend on row order.  ``per_user=False`` reproduces the original grouping by window only
    (all users share one row; the id is the earliest event's user).
    This is a hash aggregate with map-side partial aggregation, so a hot user
    or window does not concentrate raw rows in one task.
    """
    keys = [F.window(ts, size).alias("window")]
    aggs = []
    if per_user:
        # one wearer's events have distinct times: a fixed-width key keeps
        # this a hash aggregate (no sort of the events)
        order = F.col(ts)
        keys.append(F.col("user_id"))
    else:
        # users share windows and may share a timestamp: break ties by event id
        order = F.struct(F.col(ts), F.col("event_id")) if "event_id" in vitals.columns else F.col(ts)
        aggs.append(F.min_by("user_id", order).alias("user_id"))
    aggs += [F.min_by("lat", order).alias("lat"), F.min_by("lng", order).alias("lng")]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in VITAL_COLUMNS]
    aggs.append(F.count(F.lit(1)).alias("n_events"))
    out = vitals.groupBy(*keys).agg(*aggs)
    if keep_struct:
        return out
    return out.select(
        "user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "lat", "lng", *[f"avg_{c}" for c in VITAL_COLUMNS], "n_events")
