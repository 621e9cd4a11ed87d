"""Operators that no driver query shows alone: key look-up, empty join sides,
stamping, ids, the whole cohort chain, debug sinks and output modes."""

import datetime as dt

from pyspark.sql import functions as F

from airwell.functions import prepare as P
from airwell.operators import joins as J
from airwell.operators.cohort import cohort
from airwell.session import new_work_path
from airwell.sources import files as FI
from airwell.sources import messages as MS
from airwell.sources import tables as T
from airwell.streaming import pipelines as SP

from conftest import SF001


def test_profile_lookup_by_key_reaches_the_scan(spark):
    path = new_work_path(spark, "profiles")
    T.profiles(spark, SF001).write.mode("overwrite").parquet(path)
    one = FI.lookup_profile(spark.read.parquet(path), 7)
    assert [r.user_id for r in one.collect()] == [7]
    assert "EqualTo(user_id,7)" in one._jdf.queryExecution().toString()
    assert FI.lookup_profile(spark.read.parquet(path), -1).count() == 0


def test_an_empty_side_gives_no_rows(spark):
    r = T.readings(spark, SF001)
    weather, pollen = r.select("municipality_id", "ts", "temperature_2m"), r.select("municipality_id", "ts", "birch_pollen")
    assert J.weather_pollen(weather.limit(0), pollen).count() == 0
    assert J.weather_pollen(weather, pollen.limit(0)).count() == 0


def test_stamp_and_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert {r.timestamp for r in P.stamp(df, at).collect()} == {at}
    ids = df.select(P.stable_id("k", "v").alias("s"), P.random_id().alias("r")).collect()
    assert len({r.s for r in ids}) == len({r.r for r in ids}) == 2
    assert [r.s for r in ids] == [r.s for r in df.select(P.stable_id("k", "v").alias("s")).collect()]


def test_cohort_chain(spark):
    p = T.profiles(spark, SF001).select("user_id", "age", "bmi", "family_history_asthma", "hay_fever", F.lit("x").alias("spare"))
    out = cohort(p, "user_id", 2024, drop=["spare"], round_cols=["bmi"])
    assert "age" not in out.columns and "spare" not in out.columns and out.count() == p.count()
    assert out.where("eczema is null or asthma_allergy is null or hay_fever is null or date_of_birth is null").count() == 0
    assert out.where("round(bmi, 1) <> bmi").count() == 0
    assert out.orderBy("user_id").collect() == cohort(p.repartition(3), "user_id", 2024, drop=["spare"], round_cols=["bmi"]).orderBy("user_id").collect()


def _topic(spark, name):
    base = new_work_path(spark, name)
    MS.publish_in_time_order(T.vitals(spark, SF001).limit(200), MS.vitals_messages, "ts", f"{base}/topic")
    return base, SP.parse_vitals(MS.file_stream(spark, f"{base}/topic", max_files_per_trigger=1))


def test_complete_mode_and_console(spark):
    base, events = _topic(spark, "t-complete")
    q = SP.to_memory(SP.windowed_vitals_stream(events), "windows_complete", "complete")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("windows_complete").agg(F.sum("n_events")).first()[0] == 200
    c = SP.to_console(SP.windowed_vitals_stream(events), f"{base}/console", "update", rows=2)
    c.awaitTermination()
    assert c.exception() is None


def test_update_mode_keeps_the_newest_row_per_window(spark):
    base, events = _topic(spark, "t-update")
    win = SP.windowed_vitals_stream(events, "1 minute", "1 day")
    for _ in range(2):      # the second run finds nothing new
        SP.run_update_to_state(win, f"{base}/state", f"{base}/checkpoint", ["user_id", "window_start"], ["n_events"])
    rows = SP.read_snapshot(spark, f"{base}/state")
    assert rows.agg(F.sum("n_events")).first()[0] == 200
    assert rows.groupBy("user_id", "window_start").count().where("count > 1").count() == 0
