"""Structured Streaming pipelines (T1-T10, K1-K4, K8) built from the same
parsing, window and scoring builders as the batch plans.

* vitals: (key, value) messages -> typed rows -> event-time watermark ->
  1-minute tumbling windows per user (append mode: each window is emitted
  once, when the watermark passes its end, and its state is dropped).
* readings: messages -> history sink and latest-state snapshot in one
  ``foreachBatch`` (K8), each write idempotent per batch id.
* profiles: messages with any key spelling -> normalised -> append sink.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from airwell.functions import classify as C
from airwell.functions.prepare import epoch_to_ts, year_of
from airwell.functions.scoring import nan_to_null
from airwell.operators.asof import latest_per_key
from airwell.operators.windows import VITAL_COLUMNS
from airwell.session import _fs, list_names, new_work_path, path_exists

CORRUPT = "_corrupt_record"
KEPT_VERSIONS = 3       # of a snapshot: the current one, the one it was made from, and one more for slow readers

# -- schemas: the fixed field lists of the topics' messages ---------------------
READING_NUMBERS = [
    "latitude", "longitude", "alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen", "olive_pollen",
    "ragweed_pollen", "temperature_2m", "timestamp", "relative_humidity_2m", "precipitation", "rain", "cloud_cover",
    "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high", "wind_speed_10m", "soil_temperature_0_to_7cm", "pm10",
    "pm2_5", "carbon_monoxide", "carbon_dioxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone",
    "aerosol_optical_depth", "dust", "uv_index", "uv_index_clear_sky", "ammonia", "european_aqi", "us_aqi"]
PROFILE_MESSAGE_FIELDS = [("user_id", "string"), ("gender", "boolean"), ("education_level", "int")] + [
    (c, t) for t, names in (
        ("float", ["bmi"]), ("boolean", ["current_smoker"]),
        ("float", ["physical_activity", "diet_quality", "sleep_quality", "pollution_exposure", "pollen_exposure", "dust_exposure"]),
        ("boolean", ["pet_allergy", "family_history_asthma", "history_of_allergies", "eczema", "hay_fever", "wheezing",
                     "shortness_of_breath", "chest_tightness", "coughing", "nighttime_symptoms", "exercise_induced", "obesity", "cad"]),
        ("float", ["cad_probability"]),
        ("boolean", ["ragweed_pollen_allergy", "grass_pollen_allergy", "mugwort_pollen_allergy", "birch_pollen_allergy",
                     "alder_pollen_allergy", "olive_pollen_allergy", "asthma_allergy"])) for c in names] + [("date_of_birth", "date")]

# reading_id and event_id are optional: producers that number their messages send them
READING_SCHEMA = TT.StructType(
    [TT.StructField("municipality_id", TT.LongType()), TT.StructField("name", TT.StringType())]
    + [TT.StructField(c, TT.DoubleType()) for c in READING_NUMBERS]
    + [TT.StructField("reading_id", TT.LongType()), TT.StructField(CORRUPT, TT.StringType())])

VITALS_SCHEMA = TT.StructType(
    [TT.StructField(c, TT.DoubleType()) for c in VITAL_COLUMNS] + [TT.StructField("id", TT.StringType())]
    + [TT.StructField(c, TT.DoubleType()) for c in ("lat", "lng", "timestamp")]
    + [TT.StructField("event_id", TT.LongType()), TT.StructField(CORRUPT, TT.StringType())])

_JSON_OPTS = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}


# -- parsing (P1-P4, P7, D18) ----------------------------------------------------
def _parsed(msgs: DataFrame, schema: TT.StructType, keep_key: bool) -> DataFrame:
    """Typed rows; a bare NaN is missing (it would rank above every number).

    The parsed struct is a generator's row: filters on its fields stay above it,
    so a message is parsed once however many fields are asked for."""
    p = msgs.select(F.col("key").cast("string").alias("_key"),
                    F.inline(F.array(F.from_json(F.col("value").cast("string"), schema, _JSON_OPTS))))
    cols = [nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, TT.DoubleType) else F.col(f.name) for f in schema.fields]
    return p.select(*(["_key"] if keep_key else []), *cols)


def parse_readings(msgs: DataFrame, keep_key: bool = False) -> DataFrame:
    p = _parsed(msgs, READING_SCHEMA, keep_key)
    return p.withColumn("ts", epoch_to_ts(F.col("timestamp"))).drop("timestamp").withColumn("year", year_of("ts"))


def split_rejects(parsed: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Malformed records and records without one of the key fields go to a reject table."""
    bad = F.col(CORRUPT).isNotNull()
    for key in keys:
        bad = bad | F.col(key).isNull()
    return parsed.where(~bad).drop(CORRUPT), parsed.where(bad)


def vitals_rows(msgs: DataFrame, keep_key: bool = False) -> DataFrame:
    """Every vitals message, malformed ones marked.  ``msg_id`` names a message:
    its event_id, or a hash of its fields where the producer sends none (a
    redelivered message is equal in all of them)."""
    p = _parsed(msgs, VITALS_SCHEMA, keep_key)
    own = F.md5(F.to_json(F.struct("id", "timestamp", *VITAL_COLUMNS, "lat", "lng")))
    return p.select(*(["_key"] if keep_key else []), "event_id", F.coalesce(F.col("event_id").cast("string"), own).alias("msg_id"),
                    F.col("id").alias("user_id"), epoch_to_ts(F.col("timestamp")).alias("ts"), *VITAL_COLUMNS, "lat", "lng", CORRUPT)


VITALS_KEYS = ("user_id", "ts")


def parse_vitals(msgs: DataFrame) -> DataFrame:
    """Well-formed vitals; the others are what ``run_rejects`` writes."""
    return split_rejects(vitals_rows(msgs), *VITALS_KEYS)[0]


def run_rejects(rows: DataFrame, keys: tuple[str, ...], sink: str, checkpoint: str) -> None:
    """The malformed rows of a topic as a table of their own (its own query and checkpoint)."""
    run_to_parquet(split_rejects(rows, *keys)[1], sink, checkpoint)


def run_split(rows: DataFrame, keys: tuple[str, ...], sink: str, rejects: str, checkpoint: str, trigger: dict | None = None):
    """K1 + D18 in one query: each micro-batch is read and parsed once and written to the table and to the reject table,
    both below ``batch=<id>`` (a replayed batch rewrites the same files)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split_rejects(batch, *keys)
            good.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    q = (rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    if not trigger or trigger.get("availableNow"):
        q.awaitTermination()
    return q


# -- vitals windows (A1, T1-T6, T8) -------------------------------------------------
def windowed_vitals_stream(events: DataFrame, size: str = "1 minute", delay: str = "0 seconds",
                           dedup_events: bool = False) -> DataFrame:
    """Streaming A1.  ``dedup_events`` drops redelivered events (same
    msg_id) within the watermark before they are counted (T8)."""
    v = events.withWatermark("ts", delay)
    if dedup_events:
        v = v.dropDuplicatesWithinWatermark(["msg_id"])
    order = F.struct(F.col("ts"), F.col("msg_id"))
    w = (v.groupBy(F.window("ts", size).alias("window"), "user_id")
          .agg(F.min_by(F.struct("lat", "lng"), order).alias("at"),
               *[F.avg(c).alias(f"avg_{c}") for c in VITAL_COLUMNS], F.count(F.lit(1)).alias("n_events")))
    return w.select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "at.lat", "at.lng", *[f"avg_{c}" for c in VITAL_COLUMNS], "n_events")


def run_to_parquet(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                   trigger: dict | None = None, partition_by: list[str] | None = None):
    """K1: append sink with its own checkpoint; ``availableNow`` by default
    (processes what is there, then stops).  Production passes
    ``{"processingTime": "1 minute"}`` (T5)."""
    w = (df.writeStream.outputMode(mode).format("parquet")
         .option("checkpointLocation", checkpoint).option("path", sink))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(**(trigger or {"availableNow": True})).start()
    if not trigger or trigger.get("availableNow"):
        q.awaitTermination()
    return q


def run_update_to_state(df: DataFrame, state: str, checkpoint: str, key: list[str], order: list[str],
                        trigger: dict | None = None):
    """T4, update mode: every micro-batch holds the rows that changed; they are
    merged into a versioned table of the current row per ``key`` (greatest
    ``order``).  A batch id that has a version is not written again."""
    spark = df.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        versions = snapshot_versions(spark, state)
        if batch_id in versions:
            return
        prev = [v for v in versions if v < batch_id]
        both = batch if not prev else spark.read.parquet(f"{state}/v={prev[-1]}").unionByName(batch)
        write_version(latest_per_key(both, key, order), state, batch_id)

    q = (df.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    if not trigger or trigger.get("availableNow"):
        q.awaitTermination()
    return q


def to_console(df: DataFrame, checkpoint: str, mode: str = "append", rows: int = 20, trigger: dict | None = None):
    """K4: print each micro-batch's first rows (debugging)."""
    return (df.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", False)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, mode: str = "append",
             trigger: str = "1 minute"):
    """K3: (key, value) sink to a topic with a processing-time trigger."""
    return (df.writeStream.outputMode(mode).format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start())


def to_memory(df: DataFrame, name: str, mode: str = "append"):
    """K4: debug sink in a table of the session."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()


def recommendation_messages(scored: DataFrame) -> DataFrame:
    """key = window end (epoch seconds, text); value = JSON with the user, the window and the list."""
    return scored.select(F.unix_timestamp("window_end").cast("string").alias("key"),
                         F.to_json(F.struct("user_id", "window_end", "recommendations")).alias("value"))


# -- readings: history + latest state (K1, K2, K8, T7, T10) -------------------------
def snapshot_versions(spark: SparkSession, state: str) -> list[int]:
    """Committed snapshot versions (folders ``v=<batch>`` with _SUCCESS)."""
    return sorted(int(d[2:]) for d in list_names(spark, state)
                  if d.startswith("v=") and path_exists(spark, f"{state}/{d}/_SUCCESS"))


def write_version(df: DataFrame, folder: str, batch_id: int, keep: int = KEPT_VERSIONS) -> None:
    """Write a snapshot as version ``batch_id`` and remove those beyond the ``keep`` newest: the folder and its
    listing stay as small as that.  A version that exists is not written again."""
    spark = df.sparkSession
    if batch_id in snapshot_versions(spark, folder):
        return
    df.write.mode("overwrite").parquet(f"{folder}/v={batch_id}")
    for old in snapshot_versions(spark, folder)[:-keep]:
        fs, path = _fs(spark, f"{folder}/v={old}")
        fs.delete(path, True)


def read_snapshot(spark: SparkSession, state: str) -> DataFrame | None:
    vs = snapshot_versions(spark, state)
    return spark.read.parquet(f"{state}/v={vs[-1]}") if vs else None


def latest_state_writer(spark: SparkSession, state: str, history: str, risk: str | None = None,
                        rejects: str | None = None,
                        key: str = "municipality_id", order=("ts", "reading_id", "pm10")):
    """foreachBatch function for K8: per micro-batch
    * history: the batch's rows under ``batch=<id>/year=<y>`` (overwrite, so a
      replayed batch rewrites the same files);
    * latest state: previous snapshot U batch -> newest row per key, written
      as version ``v=<id>``; a version that exists is not written again;
    * risk table (T10): recomputed from the new snapshot; each output is
      checked on its own, so a batch that failed in between is completed;
    * malformed rows under ``rejects/batch=<id>`` (D18).
    The merge is a set operation on executors; nothing is collected."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)   # read by several writes
        try:
            good = batch
            if CORRUPT in batch.columns:
                good, bad = split_rejects(batch, key, "ts")
                if rejects:
                    bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
            _write(good, batch_id)
        finally:
            batch.unpersist()

    def _write(good: DataFrame, batch_id: int) -> None:
        (good.write.mode("overwrite").partitionBy("year")
             .parquet(f"{history}/batch={batch_id}"))
        versions = snapshot_versions(spark, state)
        if batch_id not in versions:
            prev = [v for v in versions if v < batch_id]
            snap = spark.read.parquet(f"{state}/v={prev[-1]}") if prev else None
            both = good if snap is None else snap.unionByName(good)
            merged = latest_per_key(both, [key], list(order))
            write_version(merged, state, batch_id)
        if risk and batch_id not in snapshot_versions(spark, risk):
            write_version(C.risk_table(spark.read.parquet(f"{state}/v={batch_id}")), risk, batch_id)
    return run


def run_readings_stream(spark: SparkSession, source: str, base: str | None = None,
                        max_files_per_trigger: int | None = 1) -> dict:
    """Readings topic -> history + latest state + risk table, availableNow."""
    from airwell.sources.messages import file_stream
    base = base or new_work_path(spark, "readings-stream")
    paths = {k: f"{base}/{k}" for k in ("history", "state", "risk", "rejects", "checkpoint")}
    parsed = parse_readings(file_stream(spark, source, max_files_per_trigger))
    q = (parsed.writeStream.foreachBatch(latest_state_writer(
            spark, paths["state"], paths["history"], paths["risk"], paths["rejects"]))
         .option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True).start())
    q.awaitTermination()
    return paths


# -- profiles (user stream, D10) ---------------------------------------------------
def normalised_json_map(value) -> F.Column:
    """JSON object -> MAP<STRING,STRING> with snake_case keys, so CamelCase
    producers and snake_case schemas meet (D10)."""
    m = F.from_json(F.col(value) if isinstance(value, str) else value, "map<string,string>")
    return F.transform_keys(m, lambda k, v: F.lower(F.regexp_replace(
        F.regexp_replace(k, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")))


def profile_rows(msgs: DataFrame, fields: list[tuple[str, str]] = PROFILE_MESSAGE_FIELDS,
                 mark_rejects: bool = False) -> DataFrame:
    """Typed profile rows from normalised maps; booleans accept true/false/1/0.
    ``mark_rejects`` keeps the text of malformed messages (see split_rejects)."""
    m = msgs.select(normalised_json_map(F.col("value").cast("string")).alias("m"), F.col("value").cast("string").alias("_v"))
    cols = []
    for name, typ in fields:
        raw = F.col("m")[name]
        if typ == "boolean":
            c = F.when(F.lower(raw).isin("true", "1", "1.0"), F.lit(True)).when(
                F.lower(raw).isin("false", "0", "0.0"), F.lit(False))
        else:
            c = raw.try_cast(typ)
        cols.append(c.alias(name))
    if mark_rejects:
        cols.append(F.when(F.coalesce(F.size("m"), F.lit(0)) <= 0, F.col("_v")).alias(CORRUPT))
    return m.select(*cols)


# -- recommendations (3.1 end to end: A1 -> J4/J5/J6 -> R1-R15 -> K3, T9) -----------
def recommendations_writer(spark: SparkSession, out: str, sites: DataFrame, readings: DataFrame,
                           profiles: DataFrame, latest: str | None = None, carry: str | None = None, current: bool = False):
    """foreachBatch function: each micro-batch holds windows that just
    closed; they are enriched and scored with the batch operators and written
    as (key, value) messages (K3 shape) under ``batch=<id>`` (overwrite:
    a replayed batch rewrites the same files).  ``readings`` and ``profiles``
    may be functions that open the table: a frame keeps the file list it was
    made with, a function sees what arrived since.  ``latest`` keeps the current
    text per (user, category) as versioned snapshots (T9).

    Windows close in event-time order, so a batch needs the readings since the
    last batch's newest window and, from before, one row per site: these are kept
    as versions below ``carry`` (J5 without the history).  With ``current`` the
    windows meet that table of each site's latest reading and nothing else: no
    reading is looked up by time."""
    from airwell.api import recommend
    from airwell.operators.latest import advice_items, latest_by_category
    from airwell.operators.spatial import site_levels
    from airwell.sinks.tables import merge_latest
    from airwell.sources.messages import write_messages

    levels = site_levels(sites)   # static side: one grid for the whole stream
    # ids of the vitals topic are text; frames of files are read again per batch
    fresh = lambda df: df() if callable(df) else df

    def run(batch: DataFrame, batch_id: int) -> None:
        # the batch and its scores feed two writes: compute them once
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _write(batch, batch_id)
        finally:
            batch.unpersist()

    def _write(batch: DataFrame, batch_id: int) -> None:
        people = fresh(profiles)
        people = people.withColumn("user_id", F.col("user_id").cast("string"))
        known = _environment(batch, batch_id)
        if known is None:       # no window closed
            return
        rec = recommend(batch, sites, known, people, levels=levels).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _emit(rec, batch_id)
        finally:
            rec.unpersist()

    def _environment(batch: DataFrame, batch_id: int) -> DataFrame | None:
        """The readings that the batch's windows can meet."""
        if current:     # every window after the state's own time: the as-of reading is the latest one
            top = batch.agg(F.min("window_end")).first()[0]
            return fresh(readings).withColumn("ts", F.least("ts", F.lit(top))) if top else None
        top = batch.agg(F.max("window_end")).first()[0]
        if top is None or carry is None:
            return None if top is None else fresh(readings)
        prev = [v for v in snapshot_versions(spark, carry) if v < batch_id]
        rows = fresh(readings).where(F.col("ts") <= F.lit(top))
        if prev:
            before = spark.read.parquet(f"{carry}/v={prev[-1]}")
            bound = before.agg(F.max("bound")).first()[0]
            if bound is not None:
                rows = before.drop("bound").unionByName(rows.where(F.col("ts") > F.lit(bound)))
        last = latest_per_key(rows, ["municipality_id"], ["ts", "reading_id", "pm10"])
        write_version(last.withColumn("bound", F.lit(top)), carry, batch_id)
        return rows

    def _emit(rec: DataFrame, batch_id: int) -> None:
        write_messages(recommendation_messages(rec), f"{out}/batch={batch_id}", "overwrite")
        if latest is None or batch_id in snapshot_versions(spark, latest):
            return
        items = latest_by_category(advice_items(rec, "user_id", "window_end"))
        items = items.withColumn("uc", F.concat_ws("\u0001", F.col("user_id").cast("string"), "category"))
        prev = [v for v in snapshot_versions(spark, latest) if v < batch_id]
        snap = spark.read.parquet(f"{latest}/v={prev[-1]}") if prev else None
        write_version(merge_latest(snap, items, "uc", ["window_end"]), latest, batch_id)
    return run


def run_recommendations_stream(spark: SparkSession, source: str, sites: DataFrame, readings: DataFrame,
                               profiles: DataFrame, base: str | None = None, size: str = "1 minute",
                               delay: str = "0 seconds", max_files_per_trigger: int | None = None, current: bool = False) -> dict:
    from airwell.sources.messages import file_stream
    base = base or new_work_path(spark, "recommendations")
    paths = {k: f"{base}/{k}" for k in ("out", "latest", "carry", "rejects", "checkpoint")}
    run_rejects(vitals_rows(file_stream(spark, source), keep_key=True), VITALS_KEYS, paths["rejects"],
                f"{paths['checkpoint']}-rejects")
    win = windowed_vitals_stream(parse_vitals(file_stream(spark, source, max_files_per_trigger)), size, delay)
    q = (win.writeStream.outputMode("append")
         .foreachBatch(recommendations_writer(spark, paths["out"], sites, readings, profiles, paths["latest"], paths["carry"], current))
         .option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True).start())
    q.awaitTermination()
    return paths


# -- late rows (T3) ------------------------------------------------------------------
def run_late_rows(events: DataFrame, late: str, seen: str, checkpoint: str, size: str = "1 minute", delay: str = "0 seconds"):
    """The rows that the windowed stream drops, kept.  A row is late if its window had closed before its batch:
    the window's end is not after the newest event time of earlier batches less the delay (the watermark).  That
    time is the only state, one row per version below ``seen``; late rows go below ``late``/batch=<id>."""
    spark = events.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        prev = [v for v in snapshot_versions(spark, seen) if v < batch_id]
        top = spark.read.parquet(f"{seen}/v={prev[-1]}").first()["top"] if prev else None
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            closed = F.window("ts", size)["end"] <= F.lit(top) - F.expr(f"INTERVAL {delay}") if top is not None else F.lit(False)
            batch.where(closed).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
            newest = batch.agg(F.greatest(F.max("ts"), F.lit(top).cast("timestamp")).alias("top"))
            write_version(newest, seen, batch_id)
        finally:
            batch.unpersist()

    q = (events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def message_items(msgs: DataFrame) -> DataFrame:
    """Recommendation messages -> (user_id, category, content, window_end) per entry."""
    from airwell.functions.prepare import has_category, split_category
    v = F.from_json(F.col("value").cast("string"), "struct<user_id:string, window_end:timestamp, recommendations:array<string>>")
    rows = msgs.select(F.inline(F.array(v))).select("user_id", "window_end", F.explode("recommendations").alias("advice"))
    cat, content = split_category("advice")
    return rows.where(has_category("advice")).select("user_id", cat.alias("category"), content.alias("content"), "window_end")


# -- the shown recommendation per category, with a time to live (T9) -------------------
NO_TIME = -9223372036854776     # microseconds that stand for a missing time: before every other
CURRENT_BUCKETS = 1024      # of the keyed state; a stream keeps the number it started with
CURRENT_TYPE = "user_id string, category string, content string, micros long, expired boolean"
CURRENT_STATE = "users array<string>, categories array<string>, contents array<string>, micros array<long>, timers array<long>"


def current_by_category(items: DataFrame, ttl: str = "6 hours", delay: str = "0 seconds", buckets: int = CURRENT_BUCKETS) -> DataFrame:
    """Updates of the current text per (user, category) of a stream of items (user_id, category, content,
    window_end).  A newer text replaces the older; a text that nothing has replaced for ``ttl`` of event time
    expires by a timer and leaves the state, so the state holds what is shown and no more.  At ``ttl`` it has expired.

    The keys are hashed into ``buckets``; a bucket's texts and their timers are one row of state, whose own timer is
    the first of them: a call of the Python function costs milliseconds, so it is made per bucket and not per key.
    Take so many that the texts of one bucket fit a task."""
    import pandas as pd

    span = int(pd.Timedelta(ttl).total_seconds() * 1000)
    names = [c.split()[0] for c in CURRENT_TYPE.split(", ")]

    def step(key, frames, state):
        mark = state.getCurrentWatermarkMs()
        held = {}
        if state.exists:
            users, categories, contents, micros, timers = state.get
            held = dict(zip(zip(users, categories), zip(contents, micros, timers)))
        given = set()
        for frame in () if state.hasTimedOut else frames:
            for user, category, content, end in zip(*(frame[c].tolist() for c in ("user_id", "category", "content", "_us"))):
                k = (user, category)
                now = held.get(k)
                if now is None or (end, content) > (now[1], now[0]):
                    held[k] = (content, end, None)
                given.add(k)
        for k in given:
            content, end, _ = held[k]
            held[k] = (content, end, max(end // 1000 + span - 1, mark + 1))     # a timer fires behind its time: at the end of the span
        gone = [k for k, (_, _, timer) in held.items() if timer < mark]
        rows = [(*k, *held[k][:2], False) for k in given] + [(*k, *held.pop(k)[:2], True) for k in gone]
        if held:
            contents, micros, timers = zip(*held.values())
            state.update((*map(list, zip(*held)), list(contents), list(micros), list(timers)))
            state.setTimeoutTimestamp(min(timers))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=names)

    t = (items.withWatermark("window_end", delay)
         .withColumn("_us", F.coalesce(F.unix_micros("window_end"), F.lit(NO_TIME)))
         .withColumn("_bucket", F.pmod(F.xxhash64("user_id", "category"), F.lit(buckets))))
    out = t.groupBy("_bucket").applyInPandasWithState(step, CURRENT_TYPE, CURRENT_STATE, "update", "EventTimeTimeout")
    return out.select("user_id", "category", "content", F.timestamp_micros("micros").alias("window_end"), "expired")


def run_current(items: DataFrame, shown: str, checkpoint: str, ttl: str = "6 hours"):
    """The table of shown texts, a version per micro-batch: updates replace rows, expired ones go."""
    spark = items.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        prev = [v for v in snapshot_versions(spark, shown) if v < batch_id]
        both = batch if not prev else spark.read.parquet(f"{shown}/v={prev[-1]}").withColumn("expired", F.lit(False)).unionByName(batch)
        rows = latest_per_key(both, ["user_id", "category"], ["window_end", "expired", "content"])
        write_version(rows.where(~F.col("expired")).drop("expired"), shown, batch_id)

    q = (current_by_category(items, ttl).writeStream.outputMode("update").foreachBatch(run)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
