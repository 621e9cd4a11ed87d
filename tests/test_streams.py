"""Streams equal batch (T1-T8, K1, K2, K8), late data, idempotent restart."""

import datetime as dt

from pyspark.sql import functions as F

from airwell.operators.windows import vitals_window
from airwell.session import new_work_path
from airwell.sources import messages as MS
from airwell.sources import tables as T
from airwell.streaming import pipelines as SP

from conftest import SF001


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_vitals_stream_equals_batch_and_drops_late(spark):
    v = T.vitals(spark, SF001)
    base = new_work_path(spark, "t-vitals")
    src = f"{base}/topic"
    MS.write_message_files(spark, MS.vitals_messages(v), "v", files=2, path=src)
    ev = SP.parse_vitals(MS.file_stream(spark, src))
    SP.run_to_parquet(SP.windowed_vitals_stream(ev), f"{base}/sink", f"{base}/ckpt")
    got = spark.read.parquet(f"{base}/sink")
    maxts = v.agg(F.max("ts")).first()[0]
    exp = vitals_window(v.withColumn("user_id", F.col("user_id").cast("string"))).where(F.col("window_end") <= F.lit(maxts))
    cols = ["user_id", "window_start", "n_events"]
    assert _rows(got, cols) == _rows(exp, cols)

    # a late message (behind the watermark) arrives in a new file: dropped, and
    # the restarted query (same checkpoint) emits nothing twice
    late = v.limit(1).withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 DAYS"))
    MS.write_message_files(spark, MS.vitals_messages(late), "v", path=src)
    before = got.count()
    SP.run_to_parquet(SP.windowed_vitals_stream(SP.parse_vitals(MS.file_stream(spark, src))),
                      f"{base}/sink", f"{base}/ckpt")
    after = spark.read.parquet(f"{base}/sink")
    assert after.count() == before
    assert after.groupBy("user_id", "window_start").count().where("count > 1").count() == 0


def test_redelivery_is_deduplicated(spark):
    v = T.vitals(spark, SF001)
    base = new_work_path(spark, "t-dedup")
    msgs = MS.vitals_messages(v)
    MS.write_message_files(spark, msgs, "v", files=2, path=f"{base}/topic")
    MS.write_message_files(spark, msgs, "v", files=2, path=f"{base}/topic")
    ev = SP.parse_vitals(MS.file_stream(spark, f"{base}/topic"))
    SP.run_to_parquet(SP.windowed_vitals_stream(ev, dedup_events=True), f"{base}/sink", f"{base}/ckpt")
    got = spark.read.parquet(f"{base}/sink")
    maxts = v.agg(F.max("ts")).first()[0]
    exp = vitals_window(v.withColumn("user_id", F.col("user_id").cast("string"))).where(F.col("window_end") <= F.lit(maxts))
    assert _rows(got, ["user_id", "window_start", "n_events"]) == _rows(exp, ["user_id", "window_start", "n_events"])


def test_latest_state_stream(spark):
    r = T.readings(spark, SF001)
    base = new_work_path(spark, "t-readings")
    MS.write_message_files(spark, MS.reading_messages(r), "r", files=3, path=f"{base}/topic")
    paths = SP.run_readings_stream(spark, f"{base}/topic", base=base, max_files_per_trigger=1)
    versions = SP.snapshot_versions(spark, paths["state"])
    assert len(versions) >= 3
    snap = SP.read_snapshot(spark, paths["state"])
    from airwell.operators.asof import latest_per_key
    exp = latest_per_key(r, ["municipality_id"], ["ts", "reading_id", "pm10"])
    cols = ["municipality_id", "reading_id", "ts"]
    assert _rows(snap, cols) == _rows(exp, cols)
    assert spark.read.parquet(paths["history"]).count() == r.count()
    risk = spark.read.parquet(f"{paths['risk']}/v={versions[-1]}")
    assert risk.count() == 6 * exp.count()
    # a batch that failed between the snapshot and the risk table is completed on replay
    again = f"{base}/risk-again"
    SP.latest_state_writer(spark, paths["state"], f"{base}/history-again", again)(r.withColumn("year", F.year("ts")), versions[-1])
    assert spark.read.parquet(f"{again}/v={versions[-1]}").count() == 6 * exp.count()
    # replaying the last batch id does not write a new version
    SP.latest_state_writer(spark, paths["state"], paths["history"])(r.limit(0).withColumn("year", F.lit(2024)),
                                                                     versions[-1])
    assert SP.snapshot_versions(spark, paths["state"]) == versions


def test_profile_stream_camelcase(spark):
    rows = [('{"UserId": 7, "Gender": 1, "Age": 30, "Bmi": 22.5, "HayFever": true, "FamilyHistoryAsthma": 0}',)]
    df = spark.createDataFrame(rows, "value string")
    out = SP.profile_rows(df, [("user_id", "bigint"), ("gender", "boolean"), ("age", "bigint"), ("bmi", "double"),
                               ("hay_fever", "boolean"), ("family_history_asthma", "boolean"), ("eczema", "boolean")]).first()
    assert tuple(out) == (7, True, 30, 22.5, True, False, None)


def test_rejects(spark):
    msgs = spark.createDataFrame([("1", '{"reading_id": 5, "municipality_id": 1, "timestamp": 1700000000.5, "pm10": 3.0}'),
                                  ("2", '{"reading_id": 6, "municipality_id": 1, "timestamp": 17'), ("3", "garbage"),
                                  ("4", '{"municipality_id": 2, "timestamp": 1.0, "alder_pollen": NaN, "name": "x"}')],
                                 "key string, value string")
    good, bad = SP.split_rejects(SP.parse_readings(msgs, keep_key=True), "municipality_id", "ts")
    assert [r["_key"] for r in good.collect()] == ["1", "4"]
    assert good.where("_key = 4").first()["alder_pollen"] is None    # a bare NaN is missing
    assert sorted(r["_key"] for r in bad.collect()) == ["2", "3"]
    assert good.first()["ts"] == dt.datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_processing_time_trigger(spark):
    """T5: the same pipeline under a processing-time trigger (1 s here,
    1 minute in production), stopped once everything has been processed."""
    v = T.vitals(spark, SF001)
    base = new_work_path(spark, "t-trigger")
    MS.publish_in_time_order(v, MS.vitals_messages, "ts", f"{base}/topic")
    ev = SP.parse_vitals(MS.file_stream(spark, f"{base}/topic", max_files_per_trigger=1))
    q = SP.run_to_parquet(SP.windowed_vitals_stream(ev), f"{base}/sink", f"{base}/ckpt",
                          trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(f"{base}/sink")
    assert got.count() > 0
    assert got.groupBy("user_id", "window_start").count().where("count > 1").count() == 0


def test_rejects_of_all_topics(spark):
    r = T.readings(spark, SF001).limit(20)
    base = new_work_path(spark, "t-rejects")
    bad = spark.createDataFrame([("k", "{broken"), ("k", '{"pm10": 1.0}')], "key string, value string")
    MS.write_message_files(spark, MS.reading_messages(r).unionByName(bad), "r", path=f"{base}/topic")
    paths = SP.run_readings_stream(spark, f"{base}/topic", base=base)
    assert spark.read.parquet(paths["rejects"]).count() == 2
    assert spark.read.parquet(paths["history"]).count() == 20
    v = MS.vitals_messages(T.vitals(spark, SF001).limit(5)).unionByName(bad)
    good, rejected = SP.split_rejects(SP.vitals_rows(v), *SP.VITALS_KEYS)
    assert (good.count(), rejected.count()) == (5, 2)
    p = spark.createDataFrame([("k", '{"UserId": "a-1", "Gender": true}'), ("k", "{broken"), ("k", '{"Gender": true}')],
                              "key string, value string")
    good, rejected = SP.split_rejects(SP.profile_rows(p, mark_rejects=True), "user_id")
    assert [x["user_id"] for x in good.collect()] == ["a-1"] and rejected.count() == 2


def test_messages_without_event_id_are_deduplicated_by_content(spark):
    v = T.vitals(spark, SF001).withColumn("event_id", F.lit(None).cast("bigint"))
    base = new_work_path(spark, "t-dedup-content")
    msgs = MS.vitals_messages(v)
    MS.write_message_files(spark, msgs.unionByName(msgs), "v", path=f"{base}/topic")
    ev = SP.parse_vitals(MS.file_stream(spark, f"{base}/topic"))
    SP.run_to_parquet(SP.windowed_vitals_stream(ev, dedup_events=True), f"{base}/sink", f"{base}/ckpt")
    got = spark.read.parquet(f"{base}/sink").agg(F.sum("n_events")).first()[0]
    exp = vitals_window(T.vitals(spark, SF001)).where(F.col("window_end") <= F.lit(v.agg(F.max("ts")).first()[0])) \
        .agg(F.sum("n_events")).first()[0]
    assert got == exp


def test_a_message_is_parsed_once(spark):
    msgs = spark.createDataFrame([("k", "{}")], "key string, value string")
    for rows, keys in ((SP.parse_readings(msgs), ("municipality_id", "ts")), (SP.vitals_rows(msgs), SP.VITALS_KEYS)):
        for part in SP.split_rejects(rows, *keys):
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("from_json") == 1, plan


def test_null_and_empty_messages_are_rejected(spark):
    msgs = spark.createDataFrame([("a", None), ("b", ""), ("c", "[]"), ("d", "null"), ("e", '{"municipality_id": 1, "timestamp": 5.0}')],
                                 "key string, value string")
    good, bad = SP.split_rejects(SP.parse_readings(msgs, keep_key=True), "municipality_id", "ts")
    assert [r["_key"] for r in good.collect()] == ["e"] and bad.count() == 4


def test_snapshot_folder_stays_bounded(spark):
    base = new_work_path(spark, "t-bounded")
    for i in range(12):
        SP.write_version(spark.range(i + 1), base, i)
        SP.write_version(spark.range(99), base, i)      # a replay writes nothing
        assert SP.read_snapshot(spark, base).count() == i + 1
    assert SP.snapshot_versions(spark, base) == [9, 10, 11]


def test_time_slices_cover_the_rows(spark):
    v = T.vitals(spark, SF001)
    parts = MS.time_slices(v, "ts", 4)
    assert sum(p.count() for p in parts) == v.count()
    tops = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(tops, tops[1:]))
    assert MS.time_slices(v.limit(0), "ts", 4)[0].count() == 0


def test_recommendation_batches_read_no_history(spark):
    """Batch by batch the carry table holds one row per site, and a batch is given only the readings since the last one."""
    base = new_work_path(spark, "t-carry")
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    hour = lambda h: t0 + dt.timedelta(hours=h)
    sites = T.sites(spark, SF001).limit(1)
    site = sites.first()["municipality_id"]
    cols = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen", "olive_pollen", "ragweed_pollen", "european_aqi", "pm10",
            "pm2_5", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide", "ozone"]
    readings = spark.createDataFrame([(site, i, hour(i), *[float(i)] * len(cols)) for i in range(48)],
                                     "municipality_id long, reading_id long, ts timestamp, " + ", ".join(f"{c} double" for c in cols))
    given = []
    import airwell.api as api
    plain = api.recommend

    def watched(windows, s, env, people, **kw):
        given.append(env.count())
        return plain(windows, s, env, people, **kw)
    api.recommend = watched
    try:
        write = SP.recommendations_writer(spark, f"{base}/out", sites, lambda: readings, T.profiles(spark, SF001), f"{base}/latest", f"{base}/carry")
        avgs = ", ".join(f"avg_{c} double" for c in ("heart_rate", "ibi", "eda", "skin_temp", "activity_level"))
        for b, end in enumerate((10, 20, 21, 40)):
            win = spark.createDataFrame([("1", hour(end - 0.02), hour(end), 45.9, 10.6, *[70.0] * 5, 3)],
                                        f"user_id string, window_start timestamp, window_end timestamp, lat double, lng double, {avgs}, n_events long")
            write(win, b)
    finally:
        api.recommend = plain
    assert given == [11, 11, 2, 20]       # all up to the first bound, then one row per site and what came since
    carry = SP.read_snapshot(spark, f"{base}/carry").collect()
    assert [(r["municipality_id"], r["reading_id"]) for r in carry] == [(site, 40)]


def test_shown_texts_expire(spark):
    base = new_work_path(spark, "t-ttl")
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def send(*rows):
        items = [(u, t0 + dt.timedelta(hours=h), [f"{c}: {x}"]) for u, c, x, h in rows]
        df = spark.createDataFrame(items, "user_id string, window_end timestamp, recommendations array<string>")
        SP.recommendation_messages(df).write.mode("append").json(f"{base}/topic")
        SP.run_current(SP.message_items(MS.file_stream(spark, f"{base}/topic")), f"{base}/shown", f"{base}/checkpoint", "6 hours")
        return {(r["user_id"], r["category"]): r["content"] for r in SP.read_snapshot(spark, f"{base}/shown").collect()}
    assert send(("1", "A", "old", 0), ("2", "A", "x", 1)) == {("1", "A"): "old", ("2", "A"): "x"}
    assert send(("1", "A", "new", 3), ("1", "B", "y", 3)) == {("1", "A"): "new", ("1", "B"): "y", ("2", "A"): "x"}
    assert send(("3", "A", "z", 8)) == {("1", "A"): "new", ("1", "B"): "y", ("3", "A"): "z"}      # 2 expired at hour 7
    assert send(("3", "A", "w", 20)) == {("3", "A"): "w"}
    # the state holds what is shown: one key is left
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    assert spark.read.format("statestore").load(f"{base}/checkpoint").count() == 1


def test_shown_texts_are_kept_in_buckets(spark):
    """Many keys are few rows of state; what is shown is the newest text per key (the greater of two at one time, a missing
    user is a user), without those that have expired; late rows change nothing."""
    base = new_work_path(spark, "t-shown-buckets")
    t0, minute = dt.datetime(2024, 1, 1), 60
    keys = 3 * SP.CURRENT_BUCKETS // 2
    rows = lambda n: [(None if i == 0 else str(i), c, f"{c}{i % 3}", i % 300) for i in range(n) for c in ("A",)]
    sends = [rows(keys) + [("7", "A", "zz", 7), ("7", "B", "b", 299)],
             [("7", "A", "new", 400), (None, "A", "now", 500), ("8", "A", "late", 10), ("9", "A", "late", 299), ("7", "A", "older", 350)],
             [("1", "A", "end", 100 + 6 * minute)]]
    top, want = -1, {}
    for sent in sends:
        for u, c, x, m in sent:
            if m > top:
                want[u, c] = max(want.get((u, c), (-1, "")), (m, x))
        top = max([top] + [m for *_, m in sent])
        want = {k: v for k, v in want.items() if v[0] + 6 * minute > top}
        items = spark.createDataFrame([(u, t0 + dt.timedelta(minutes=m), [f"{c}: {x}"]) for u, c, x, m in sent],
                                      "user_id string, window_end timestamp, recommendations array<string>")
        MS.write_message_files(spark, SP.recommendation_messages(items), "i", files=2, path=f"{base}/topic")
        SP.run_current(SP.message_items(MS.file_stream(spark, f"{base}/topic")), f"{base}/shown", f"{base}/checkpoint", "6 hours")
        shown = SP.read_snapshot(spark, f"{base}/shown").collect()
        assert {(r["user_id"], r["category"]): (int((r["window_end"] - t0).total_seconds()) // 60, r["content"]) for r in shown} == want
        assert len(shown) == len(want)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        state = spark.read.format("statestore").load(f"{base}/checkpoint").select("value.*")
        state = state if "users" in state.columns else state.select("groupState.*")
        assert state.count() <= SP.CURRENT_BUCKETS
        assert state.agg(F.sum(F.size("users"))).first()[0] == len(want)


def test_batches_of_messages_are_compact_and_old_ones_are_read(spark):
    base = new_work_path(spark, "t-batches")
    msgs = spark.createDataFrame([(str(i), '{"user_id": "' + str(i) + '"}') for i in range(20)], "key string, value string")
    for kind in ("new", "old"):
        for b in range(2):
            part, path = msgs.where(F.col("key").cast("int") % 2 == b), f"{base}/{kind}/batch={b}"
            MS.write_messages(part, path, "overwrite") if kind == "new" else part.write.json(path)
        assert sorted(map(tuple, MS.read_message_files(spark, f"{base}/{kind}").select("key", "value").collect())) == sorted(map(tuple, msgs.collect()))


def test_late_rows_and_windows_make_up_the_input(spark):
    v = T.vitals(spark, SF001)
    base = new_work_path(spark, "t-late")
    first, second = MS.time_slices(v, "ts", 2)
    for part in (second, first):      # the older half arrives behind the watermark
        MS.publish_in_time_order(part, MS.vitals_messages, "ts", f"{base}/topic")
        events = SP.parse_vitals(MS.file_stream(spark, f"{base}/topic"))
        SP.run_to_parquet(SP.windowed_vitals_stream(events), f"{base}/sink", f"{base}/ckpt")
        SP.run_late_rows(events, f"{base}/late", f"{base}/seen", f"{base}/ckpt-late")
    late = spark.read.parquet(f"{base}/late").count()
    open_end = v.agg(F.max("ts")).first()[0]
    still_open = v.where(F.window("ts", "1 minute")["end"] > F.lit(open_end)).count()
    assert late > 0 and late + spark.read.parquet(f"{base}/sink").agg(F.sum("n_events")).first()[0] + still_open == v.count()


def test_topics_are_compact_and_old_ones_are_read(spark):
    """The messages' texts repeat every field name: on disk they take a small part of their length."""
    import os
    base = new_work_path(spark, "t-compact")
    msgs = MS.reading_messages(T.readings(spark, SF001))
    MS.write_message_files(spark, msgs, "r", path=f"{base}/topic")
    msgs.select("key", "value").write.json(f"{base}/lines")
    size = lambda d: sum(os.path.getsize(os.path.join(d, n)) for n in os.listdir(d) if n.startswith("part-"))
    assert 4 * size(f"{base}/topic".replace("file:", "")) < size(f"{base}/lines".replace("file:", ""))
    want = sorted(map(tuple, msgs.collect()))
    for kind in ("topic", "lines"):
        assert sorted(map(tuple, MS.read_message_files(spark, f"{base}/{kind}").collect())) == want
        SP.run_to_parquet(MS.file_stream(spark, f"{base}/{kind}"), f"{base}/{kind}-out", f"{base}/{kind}-ckpt")
        assert spark.read.parquet(f"{base}/{kind}-out").count() == len(want)


def test_position_is_kept_once_per_window(spark):
    """One ordered pair per window in the state; the first message's position, also where half of it is missing."""
    base = new_work_path(spark, "t-at")
    t0 = dt.datetime(2024, 1, 1)
    v = T.vitals(spark, SF001).limit(1).select("event_id", "user_id", "heart_rate", "ibi", "eda", "skin_temp", "activity_level", "lat", "lng")
    at = lambda s, lat, lng: v.withColumns({"ts": F.lit(t0 + dt.timedelta(seconds=s)), "lat": F.lit(lat).cast("double"), "lng": F.lit(lng).cast("double")})
    msgs = MS.vitals_messages(at(5, None, 2.0).unionByName(at(9, 3.0, 4.0)).unionByName(at(500, 5.0, 6.0)))
    MS.write_message_files(spark, msgs, "v", files=1, path=f"{base}/topic")
    win = SP.windowed_vitals_stream(SP.parse_vitals(MS.file_stream(spark, f"{base}/topic")))
    assert win._jdf.queryExecution().analyzed().toString().count("min_by(") == 1
    SP.run_to_parquet(win, f"{base}/sink", f"{base}/ckpt")
    assert [(r["lat"], r["lng"], r["n_events"]) for r in spark.read.parquet(f"{base}/sink").collect()] == [(None, 2.0, 2)]
