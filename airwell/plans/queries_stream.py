"""Streaming queries: messages derived from the driver tables are published
to a folder below the shared checkpoint folder, consumed by a Structured
Streaming query with ``availableNow``, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.operators.windows import VITAL_COLUMNS
from airwell.plans import flagship as FS
from airwell.plans import sqlfrag as Q
from airwell.plans.catalog import register
from airwell.plans.queries import LATEST_SQL, PROFILE_COLS, READING_COLS, _risk_sql, cte
from airwell.functions.scoring import fix6
from airwell.session import new_work_path
from airwell.sources import messages as MS
from airwell.sources import tables as T
from airwell.streaming import buckets as BU
from airwell.streaming import pipelines as SP

AVG_COLS = [f"avg_{c}" for c in VITAL_COLUMNS]


SLICES = 4      # the topic arrives in so many spans of time, each a micro-batch of its own


def _vitals_stream(spark: SparkSession, sf: str, redeliver: bool) -> DataFrame:
    base = new_work_path(spark, "vitals-stream")
    src, before = f"{base}/topic", None
    for part in MS.time_slices(T.vitals(spark, sf), "ts", SLICES):
        # at-least-once delivery: every message arrives twice in its own micro-batch and once more in the next one
        sent = part if not redeliver else part.unionAll(part) if before is None else part.unionAll(part).unionAll(before)
        MS.publish_in_time_order(sent, MS.vitals_messages, "ts", src)
        events = SP.parse_vitals(MS.file_stream(spark, src))
        win = SP.windowed_vitals_stream(events, "1 minute", "0 seconds", dedup_events=redeliver)
        SP.run_to_parquet(win, f"{base}/sink", f"{base}/checkpoint")
        before = part
    out = spark.read.parquet(f"{base}/sink")
    return out.select(F.col("user_id").cast("bigint").alias("user_id"), "window_start", "window_end", "lat", "lng",
                      *[fix6(c).alias(c) for c in AVG_COLS], "n_events")


STREAM_SQL = lambda: cte(["vitals"], [FS.win_sql(1)]) + f"""
SELECT user_id, window_start, window_end, lat, lng, {", ".join(f"{Q.fix6(c)} AS {c}" for c in AVG_COLS)}, n_events
FROM win WHERE window_end <= (SELECT max(ts) FROM vitals)"""  # noqa: E731


@register("vitals_stream_append", STREAM_SQL)
def vitals_stream_append(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T6 + A1: watermark 0 s, 1-minute windows, append mode; windows
    still open at the final watermark are not emitted."""
    return _vitals_stream(spark, sf, redeliver=False)


@register("vitals_stream_dedup", STREAM_SQL)
def vitals_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every message delivered twice; duplicates dropped within the
    watermark, so the windows equal the single-delivery result."""
    return _vitals_stream(spark, sf, redeliver=True)


@register("vitals_stream_update", lambda: cte(["vitals"], [FS.win_sql(1)]) + f"""
SELECT user_id, window_start, window_end, lat, lng, {", ".join(f"{Q.fix6(c)} AS {c}" for c in AVG_COLS)}, n_events FROM win""")
def vitals_stream_update(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the windows in update mode, merged batch by batch into the table of
    current windows; windows that are still open are in it too."""
    base = new_work_path(spark, "vitals-update")
    for part in MS.time_slices(T.vitals(spark, sf), "ts", SLICES):
        MS.publish_in_time_order(part, MS.vitals_messages, "ts", f"{base}/topic")
        events = SP.parse_vitals(MS.file_stream(spark, f"{base}/topic"))
        win = SP.windowed_vitals_stream(events, "1 minute", "1 day")
        SP.run_update_to_state(win, f"{base}/state", f"{base}/checkpoint", ["user_id", "window_start"], ["n_events"])
    out = SP.read_snapshot(spark, f"{base}/state")
    return out.select(F.col("user_id").cast("bigint").alias("user_id"), "window_start", "window_end", "lat", "lng",
                      *[fix6(c).alias(c) for c in AVG_COLS], "n_events")


@register("latest_reading_stream", lambda: cte(["readings"], [LATEST_SQL]) + f"SELECT {', '.join(READING_COLS)} FROM latest")
def latest_reading_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Readings topic in several micro-batches; each
    batch appends history and merges the latest-state snapshot."""
    base = new_work_path(spark, "readings-stream")
    src = f"{base}/topic"
    MS.write_message_files(spark, MS.reading_messages(T.readings(spark, sf)), "readings", path=src)
    paths = SP.run_readings_stream(spark, src, base=base, max_files_per_trigger=1)
    return SP.read_snapshot(spark, paths["state"]).select(*READING_COLS)


@register("latest_state_buckets", lambda: cte(["readings"], [LATEST_SQL]) + f"SELECT {', '.join(READING_COLS)} FROM latest")
def latest_state_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """K2 / K8 in key buckets: several micro-batches, each rewriting the buckets of its own sites."""
    base = new_work_path(spark, "bucketed-state")
    MS.write_message_files(spark, MS.reading_messages(T.readings(spark, sf)), "readings", path=f"{base}/topic")
    return BU.read_buckets(spark, BU.run_bucketed_state(spark, f"{base}/topic", base, buckets=16)).select(*READING_COLS)


RISK_STREAM_SQL = lambda: cte(["readings"], [LATEST_SQL, _risk_sql("latest")]) + f"""
SELECT municipality_id, pollen, concentration, level, {Q.class_colour('level')} AS colour FROM risk"""  # noqa: E731


@register("risk_stream", RISK_STREAM_SQL)
def risk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The risk table that the readings stream keeps beside the latest state."""
    base = new_work_path(spark, "readings-stream")
    MS.write_message_files(spark, MS.reading_messages(T.readings(spark, sf)), "readings", path=f"{base}/topic")
    paths = SP.run_readings_stream(spark, f"{base}/topic", base=base)
    return SP.read_snapshot(spark, paths["risk"]).select("municipality_id", "pollen", "concentration", "level", "colour")


# rows that must come out as they went in, one of them with a bare NaN, and one cut short
_MALFORMED = "(municipality_id + reading_id) % 11 = 0"
_NAN = "(municipality_id + reading_id) % 11 = 1"


@register("reading_message_parse", lambda: cte(["readings"]) + f"""
SELECT reading_id, municipality_id, ts, CASE WHEN {_NAN} THEN NULL ELSE pm10 END AS pm10, european_aqi, temperature_2m
FROM readings WHERE NOT {_MALFORMED}""")
def reading_message_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Reading messages in the topic's field names; by key, some
    hold a bare NaN (parsed as missing) and some are cut short (rejected)."""
    r = T.readings(spark, sf)
    body = MS.reading_messages(r.withColumn("pm10", F.when(F.expr(_NAN), F.lit(float("nan"))).otherwise(F.col("pm10")))
                               .withColumn("_bad", F.expr(_MALFORMED)).drop("year"))
    text = F.regexp_replace("value", '"pm10":"NaN"', '"pm10":NaN')
    cut = F.when(F.get_json_object("value", "$._bad") == "true", F.expr("substring(value, 1, length(value) - 9)")).otherwise(text)
    good, _ = SP.split_rejects(SP.parse_readings(body.withColumn("value", cut)), "municipality_id", "ts")
    return good.select("reading_id", "municipality_id", "ts", "pm10", "european_aqi", "temperature_2m")


@register("vitals_message_parse", lambda: cte(["vitals"]) + """
SELECT CAST(user_id AS VARCHAR) AS user_id, ts, heart_rate, lat, lng FROM vitals""")
def vitals_message_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Vitals messages as the wearable sends them, with text ids and no event id."""
    v = T.vitals(spark, sf)
    msgs = MS.vitals_messages(v.withColumn("event_id", F.lit(None).cast("bigint")))
    return SP.parse_vitals(msgs).select("user_id", "ts", "heart_rate", "lat", "lng")


@register("history_stream", lambda: cte(["readings"]) + f"""
SELECT {', '.join(READING_COLS)}, CAST(year(ts) AS INTEGER) AS year FROM readings""")
def history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """K1 via K8: the history written batch by batch holds every reading once."""
    base = new_work_path(spark, "readings-stream")
    src = f"{base}/topic"
    MS.write_message_files(spark, MS.reading_messages(T.readings(spark, sf)), "readings", path=src)
    paths = SP.run_readings_stream(spark, src, base=base, max_files_per_trigger=1)
    return spark.read.parquet(paths["history"]).select(*READING_COLS, "year")


PROFILE_FIELDS = [("user_id", "bigint"), ("gender", "boolean"), ("age", "bigint"), ("bmi", "double")] + [
    (c, "boolean") for c in PROFILE_COLS[4:]]


def _camel(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("_"))


@register("profile_stream", lambda: cte(["profiles"]) + f"SELECT {', '.join(PROFILE_COLS)} FROM profiles")
def profile_stream(spark: SparkSession, sf: str) -> DataFrame:
    """User stream with CamelCase producer keys (D10): keys normalised, rows
    typed and appended to the profile table (K1)."""
    base = new_work_path(spark, "profile-stream")
    p = T.profiles(spark, sf)
    body = F.struct(*[F.col(c).alias(_camel(c)) for c in PROFILE_COLS])
    msgs = p.select(F.col("user_id").cast("string").alias("key"), F.to_json(body).alias("value"))
    MS.write_message_files(spark, msgs, "profiles", path=f"{base}/topic")
    rows = SP.profile_rows(MS.file_stream(spark, f"{base}/topic"), PROFILE_FIELDS, mark_rejects=True)
    SP.run_split(rows, ("user_id",), f"{base}/table", f"{base}/rejects", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").select(*PROFILE_COLS)


REC_STREAM_WHERE = "WHERE window_end <= (SELECT max(ts) FROM vitals)"


def _rec_stream(spark: SparkSession, sf: str, current: bool = False) -> dict:
    base = new_work_path(spark, "rec-stream")
    readings = lambda: T.readings(spark, sf)
    if current:     # the snapshot that the readings stream keeps
        MS.write_message_files(spark, MS.reading_messages(T.readings(spark, sf)), "readings", path=f"{base}/readings")
        state = SP.run_readings_stream(spark, f"{base}/readings", base=f"{base}/env", max_files_per_trigger=None)["state"]
        readings = lambda: SP.read_snapshot(spark, state)
    for part in MS.time_slices(T.vitals(spark, sf), "ts", SLICES):
        MS.publish_in_time_order(part, MS.vitals_messages, "ts", f"{base}/topic")
        paths = SP.run_recommendations_stream(spark, f"{base}/topic", T.sites(spark, sf), readings,
                                              lambda: T.profiles(spark, sf), base=base, current=current)
    return paths


@register("recommendations_stream", lambda: _stream_rec_sql())
def recommendations_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The vitals -> recommendations stream end to end (3.1): windows close
    under the watermark, each micro-batch is enriched (nearest site, as-of
    reading, profile) and scored, and written as (key, value) messages whose
    key is the window end and whose value is JSON (D4).  Read back and
    exploded, one row per recommendation."""
    return _message_rows(spark, _rec_stream(spark, sf)["out"])


def _message_rows(spark: SparkSession, out: str) -> DataFrame:
    m = MS.read_message_files(spark, out)
    v = F.from_json("value", "struct<user_id:string, window_end:timestamp, recommendations:array<string>>")
    rows = m.select(F.col("key").cast("bigint").alias("window_key"), v.alias("v"))
    return rows.select("window_key", F.col("v.user_id").cast("bigint").alias("user_id"), "v.window_end",
                       F.posexplode("v.recommendations").alias("pos", "advice"))


def _stream_rec_sql() -> str:
    from airwell.plans.queries import _advice_list_prefix
    return _advice_list_prefix() + f"""
SELECT CAST(epoch(window_end) AS BIGINT) AS window_key, user_id, window_end, pos, advice FROM items
WHERE window_end <= (SELECT max(ts) FROM vitals)"""


def _stream_category_sql() -> str:
    from airwell.plans.queries import _advice_list_prefix
    return _advice_list_prefix() + """
SELECT user_id, category, arg_max(content, window_end) AS content, max(window_end) AS window_end FROM (
  SELECT user_id, window_end, trim(regexp_extract(advice, '^([^:]*):(.*)$', 1)) AS category,
         trim(regexp_extract(advice, '^([^:]*):(.*)$', 2)) AS content
  FROM items WHERE contains(advice, ':') AND window_end <= (SELECT max(ts) FROM vitals)) t
GROUP BY user_id, category"""


@register("category_latest_stream", lambda: _stream_category_sql())
def category_latest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The current recommendation per (user, category), replaced by newer
    ones batch by batch (versioned snapshot merge)."""
    paths = _rec_stream(spark, sf)
    snap = SP.read_snapshot(spark, paths["latest"])
    return snap.select(F.col("user_id").cast("bigint").alias("user_id"), "category", "content", "window_end")


CURRENT_SQL = """current_rows AS (
  SELECT e.* EXCLUDE (distance_km), r.* EXCLUDE (municipality_id, reading_id, ts), p.* EXCLUDE (user_id) FROM env e
  LEFT JOIN latest r USING (municipality_id) LEFT JOIN profiles p USING (user_id))"""


def _current_rec_sql() -> str:
    from airwell.plans.queries import ADVICE_LIST_SQL
    env = FS.ENV_SQL[:FS.ENV_SQL.index("envr AS")].rstrip().rstrip(",")
    parts = ", ".join(Q.advice_parts(Q.risk_score()))
    lists = ADVICE_LIST_SQL.replace("{parts}", parts).replace("full_rows", "current_rows")
    return cte(["sites", "readings", "profiles", "vitals"], [FS.win_sql(1), FS.near_sql(), env, LATEST_SQL, CURRENT_SQL, lists]) + f"""
SELECT CAST(epoch(window_end) AS BIGINT) AS window_key, user_id, window_end, pos, advice FROM items {REC_STREAM_WHERE}"""


@register("recommendations_current_stream", lambda: _current_rec_sql())
def recommendations_current_stream(spark: SparkSession, sf: str) -> DataFrame:
    """J5 / J6 with the state of now: windows meet the latest-state snapshot that the readings stream keeps, and
    the profiles; a batch reads no history."""
    return _message_rows(spark, _rec_stream(spark, sf, current=True)["out"])


LATE = "event_id % 10 = 0"      # these messages arrive one slice late


@register("vitals_late_rows", lambda: cte(["vitals"], [
    "span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM vitals)",
    f"""sent AS (SELECT v.*, ((epoch_us(ts) - lo) * {SLICES}) // (hi - lo + 1) + CASE WHEN {LATE} THEN 1 ELSE 0 END AS batch FROM vitals v, span)""",
    "tops AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sent GROUP BY batch)"]) + """
SELECT event_id, user_id, ts, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= top AS late
FROM sent JOIN tops USING (batch) WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= top""")
def vitals_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The messages that arrived behind the watermark, kept in a table of their own."""
    base = new_work_path(spark, "vitals-late")
    parts, held = MS.time_slices(T.vitals(spark, sf), "ts", SLICES), None
    for part in [*parts, None]:
        now = held if part is None else part.where(f"NOT ({LATE})")
        if part is not None and held is not None:
            now = now.unionAll(held)
        if now is None:
            continue
        MS.publish_in_time_order(now, MS.vitals_messages, "ts", f"{base}/topic")
        SP.run_late_rows(SP.parse_vitals(MS.file_stream(spark, f"{base}/topic")), f"{base}/late", f"{base}/seen", f"{base}/checkpoint")
        held = None if part is None else part.where(LATE)
    rows = spark.read.parquet(f"{base}/late")
    return rows.select("event_id", F.col("user_id").cast("bigint").alias("user_id"), "ts", F.lit(True).alias("late"))


TTL_HOURS = 6


def _shown_sql() -> str:
    return _stream_category_sql().replace("GROUP BY user_id, category", f"""GROUP BY user_id, category
HAVING max(window_end) + INTERVAL {TTL_HOURS} HOUR > (SELECT max(window_end) FROM items WHERE contains(advice, ':') AND window_end <= (SELECT max(ts) FROM vitals))""")


@register("category_shown_stream", lambda: _shown_sql())
def category_shown_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T9 with a time to live: the messages of the recommendations stream are read as a topic of their own; keyed
    state with timers holds the text that is shown per (user, category) until it is replaced or expires."""
    base = new_work_path(spark, "shown")
    sent = _rec_stream(spark, sf)["out"]
    m = MS.read_message_files(spark, sent).withColumn("_end", F.timestamp_seconds(F.col("key").cast("bigint")))
    for part in MS.time_slices(m, "_end", SLICES):
        MS.write_message_files(spark, part, "shown", path=f"{base}/topic")
        SP.run_current(SP.message_items(MS.file_stream(spark, f"{base}/topic")), f"{base}/shown", f"{base}/checkpoint", f"{TTL_HOURS} hours")
    shown = SP.read_snapshot(spark, f"{base}/shown")
    return shown.select(F.col("user_id").cast("bigint").alias("user_id"), "category", "content", "window_end")
