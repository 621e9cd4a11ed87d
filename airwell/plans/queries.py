"""Driver queries, one or more per operator of the inventory.

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables; each oracle is DuckDB SQL over the same tables.  Doubles that
can differ in the last bits between engines (aggregates, transcendental
functions) go through ``fix6`` on both sides; row-wise arithmetic is written
in the same order on both sides and compared exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airwell import constants as K
from airwell.functions import classify as C
from airwell.functions import prepare as P
from airwell.functions import scoring as S
from airwell.operators import features as W
from airwell.operators import filters as FL
from airwell.operators import joins as J
from airwell.operators import metrics as M
from airwell.operators.asof import asof_join, latest_per_key
from airwell.operators.latest import advice_items, latest_by_category, newest_per_key, upsert
from airwell.operators.spatial import DEFAULT_LEVELS, nearest_site, valley_for_points
from airwell.operators.windows import VITAL_COLUMNS, vitals_window
from airwell.plans import flagship as FS
from airwell.plans import sqlfrag as Q
from airwell.plans.catalog import register
from airwell.plans.oracle_views import with_views
from airwell.sources import tables as T

fix6 = S.fix6


def cte(views: list[str], extra: list[str] = ()) -> str:
    head = with_views(*views).rstrip()
    return head + "".join(",\n" + e for e in extra) + "\n"


AVG_COLS = [f"avg_{c}" for c in VITAL_COLUMNS]
READING_VALUES = K.POLLENS + ["european_aqi", "pm10", "pm2_5", "nitrogen_dioxide", "sulphur_dioxide",
                              "carbon_monoxide", "ozone", "temperature_2m", "precipitation"]
READING_COLS = ["reading_id", "municipality_id", "ts"] + READING_VALUES
FLAGS8 = ["alder_pollen_allergy", "birch_pollen_allergy", "grass_pollen_allergy", "mugwort_pollen_allergy",
          "olive_pollen_allergy", "ragweed_pollen_allergy", "asthma_allergy", "eczema"]


# ============================================================== flagship
register("flagship_risk", FS.flagship_sql)(FS.flagship_risk)


# ============================================================== A1 / T2 windows
@register("vitals_window_1m", lambda: cte(["vitals"], [FS.win_sql(1)]) + f"""
SELECT user_id, window_start, window_end, lat, lng, {", ".join(f"{Q.fix6(c)} AS {c}" for c in AVG_COLS)}, n_events
FROM win""")
def vitals_window_1m(spark: SparkSession, sf: str) -> DataFrame:
    w = vitals_window(T.vitals(spark, sf), "1 minute")
    return w.select("user_id", "window_start", "window_end", "lat", "lng",
                    *[fix6(c).alias(c) for c in AVG_COLS], "n_events")


@register("vitals_window_parity", lambda: cte(["vitals"]) + f"""
SELECT arg_min(user_id, (ts, event_id)) AS user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start,
       time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end,
       arg_min(lat, (ts, event_id)) AS lat, arg_min(lng, (ts, event_id)) AS lng,
       {", ".join(f"{Q.fix6(f'avg({c})')} AS avg_{c}" for c in VITAL_COLUMNS)}, count(*) AS n_events
FROM vitals GROUP BY ALL""")
def vitals_window_parity(spark: SparkSession, sf: str) -> DataFrame:
    """D1 parity: one row per window shared by all users."""
    w = vitals_window(T.vitals(spark, sf), "1 minute", per_user=False)
    return w.select("user_id", "window_start", "window_end", "lat", "lng",
                    *[fix6(c).alias(c) for c in AVG_COLS], "n_events")


# ============================================================== J4 nearest site
NEAR_OUT = "SELECT lat, lng, municipality_id, " + Q.fix6("distance_km") + " AS distance_km FROM near"


@register("nearest_site", lambda: cte(["sites", "vitals"], [FS.near_sql("vitals")]) + NEAR_OUT)
def nearest_site_q(spark: SparkSession, sf: str) -> DataFrame:
    n = nearest_site(T.vitals(spark, sf).select("lat", "lng"), T.sites(spark, sf))
    return n.select("lat", "lng", "municipality_id", fix6("distance_km").alias("distance_km"))


@register("nearest_site_grid", lambda: cte(["sites", "vitals"], [FS.near_sql("vitals")]) + NEAR_OUT)
def nearest_site_grid_q(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed cell levels (5 km cells first) instead of density-derived ones."""
    n = nearest_site(T.vitals(spark, sf).select("lat", "lng"), T.sites(spark, sf), levels=DEFAULT_LEVELS)
    return n.select("lat", "lng", "municipality_id", fix6("distance_km").alias("distance_km"))


# ============================================================== J5 / J6
@register("env_asof", lambda: cte(["sites", "vitals", "readings_hourly"], [FS.near_sql("vitals")]) + """
SELECT v.event_id, n.municipality_id, r.reading_id, r.ts AS reading_ts
FROM vitals v LEFT JOIN near n USING (lat, lng)
ASOF LEFT JOIN readings_hourly r ON n.municipality_id = r.municipality_id AND v.ts >= r.ts""")
def env_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every vitals event with the newest hourly reading of its nearest site
    at or before the event."""
    v = T.vitals(spark, sf).select("event_id", "ts", "lat", "lng")
    v = v.join(nearest_site(v.select("lat", "lng"), T.sites(spark, sf)), ["lat", "lng"], "left")
    r = T.readings(spark, sf).select("municipality_id", F.col("ts").alias("reading_ts"), "reading_id", "pm10")
    out = asof_join(v, r, "municipality_id", "ts", "reading_ts", tie_order=["reading_id", "pm10"])
    return out.select("event_id", "municipality_id", "reading_id", "reading_ts")


@register("user_profile_enrich", lambda: cte(["vitals", "profiles"], [FS.win_sql(1)]) + """
SELECT w.user_id, w.window_end, p.user_id IS NOT NULL AS has_profile, p.age, p.bmi, p.asthma_allergy, p.hay_fever,
       p.eczema, p.cad
FROM win w LEFT JOIN profiles p USING (user_id)""")
def user_profile_enrich(spark: SparkSession, sf: str) -> DataFrame:
    w = vitals_window(T.vitals(spark, sf), "1 minute")
    e = J.enrich_profile(w, T.profiles(spark, sf))
    return e.select("user_id", "window_end", "has_profile", "age", "bmi", "asthma_allergy", "hay_fever", "eczema", "cad")


# ============================================================== A4 / U3 / K6 latest and history
LATEST_SQL = """latest AS (
  SELECT * FROM readings
  QUALIFY row_number() OVER (PARTITION BY municipality_id ORDER BY ts DESC, reading_id DESC, pm10 DESC) = 1)"""


def latest_readings(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(T.readings(spark, sf), ["municipality_id"], ["ts", "reading_id", "pm10"])


@register("latest_reading", lambda: cte(["readings"], [LATEST_SQL]) + f"SELECT {', '.join(READING_COLS)} FROM latest")
def latest_reading(spark: SparkSession, sf: str) -> DataFrame:
    return latest_readings(spark, sf).select(*READING_COLS)


@register("history_newest", lambda: cte(["readings"]) + """
SELECT municipality_id, ts, reading_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT municipality_id, ts, reading_id,
         row_number() OVER (PARTITION BY municipality_id ORDER BY ts DESC, reading_id DESC, pm10 DESC) AS rank
  FROM readings) t WHERE rank <= 3""")
def history_newest(spark: SparkSession, sf: str) -> DataFrame:
    """Newest three readings per site (a top-k report)."""
    r = T.readings(spark, sf).select("municipality_id", "ts", "reading_id", "pm10")
    return newest_per_key(r, "municipality_id", ["ts", "reading_id", "pm10"], 3).select(
        "municipality_id", "ts", "reading_id", "rank")


@register("history_year_pruned", lambda: cte(["readings"]) + """
SELECT municipality_id, CAST(year(ts) AS INTEGER) AS year, ts, reading_id, pm10 FROM readings WHERE year(ts) = 2024""")
def history_year_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """K6 + P4: write the history partitioned by year, newest first within
    each site; read one year back (partition pruning)."""
    from airwell.sinks.tables import read_history, write_history
    path = write_history(spark, T.readings(spark, sf).withColumn("year", P.year_of("ts")))
    h = read_history(spark, path, years=[2024])
    return h.select("municipality_id", "year", "ts", "reading_id", "pm10")


# ============================================================== P1-P5 messages, D18 rejects
@register("reading_json_roundtrip", lambda: cte(["readings"]) + f"""
SELECT {', '.join(READING_COLS)}, CAST(year(ts) AS INTEGER) AS year FROM readings""")
def reading_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Readings -> (key, JSON value) messages on files -> typed rows again."""
    from airwell.sources.messages import read_message_files, reading_messages, write_message_files
    path = write_message_files(spark, reading_messages(T.readings(spark, sf)), "readings-json")
    from airwell.streaming.pipelines import parse_readings
    return parse_readings(read_message_files(spark, path)).select(*READING_COLS, "year")


@register("json_rejects", lambda: cte(["readings"]) + """
SELECT CAST(municipality_id AS VARCHAR) || ':' || CAST(reading_id AS VARCHAR) AS key FROM readings WHERE ozone > 90""")
def json_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose JSON is cut off parse to NULL keys and go to the
    reject table instead of flowing on."""
    from airwell.sources.messages import read_message_files, reading_messages, write_message_files
    from airwell.streaming.pipelines import parse_readings, split_rejects
    r = T.readings(spark, sf)
    key = F.concat_ws(":", F.col("municipality_id").cast("string"), F.col("reading_id").cast("string"))
    msgs = reading_messages(r, key=key).select("key", "value", F.get_json_object("value", "$.ozone").cast("double").alias("o"))
    cut = F.expr("substring(value, 1, length(value) div 2)")
    msgs = msgs.withColumn("value", F.when(F.col("o") > 90, cut).otherwise(F.col("value"))).drop("o")
    path = write_message_files(spark, msgs, "readings-corrupt")
    parsed = parse_readings(read_message_files(spark, path), keep_key=True)
    _, rejects = split_rejects(parsed, "reading_id")
    return rejects.select(F.col("_key").alias("key"))


# ============================================================== P9 / K5 / S2 / K7 / S8 / F3 profiles
PROFILE_COLS = ["user_id", "gender", "age", "bmi"] + [c for c in T.PROFILE_FLAGS if c != "gender"]


@register("profile_flags", lambda: cte(["profiles"]) + f"SELECT {', '.join(PROFILE_COLS)} FROM profiles")
def profile_flags(spark: SparkSession, sf: str) -> DataFrame:
    """K5 CSV write of 0/1 flags, S2 CSV scan with schema, P9 flags -> booleans."""
    from airwell.sources.files import read_csv
    from airwell.sinks.tables import write_csv
    p = T.profiles(spark, sf)
    ints = p.select(*[F.col(c).cast("int").alias(c) if c in T.PROFILE_FLAGS else F.col(c) for c in PROFILE_COLS])
    path = write_csv(spark, ints, "profiles-csv")
    schema = ", ".join(f"{c} {'bigint' if c in ('user_id', 'age') else 'double' if c == 'bmi' else 'int'}"
                       for c in PROFILE_COLS)
    back = read_csv(spark, path, schema)
    return P.int_flags_to_bool(back, keep=["user_id", "age", "bmi"]).select(*PROFILE_COLS)


UPSERT_SQL = """upd AS (
  SELECT p.user_id, p.bmi + 1.0e0 AS bmi FROM profiles p JOIN customer c ON c.c_custkey = p.user_id
  WHERE c.c_mktsegment = 'BUILDING')
SELECT p.user_id, coalesce(u.bmi, p.bmi) AS bmi, CASE WHEN u.user_id IS NULL THEN 1 ELSE 2 END AS load_seq
FROM profiles p LEFT JOIN upd u USING (user_id)"""


@register("profile_upsert", lambda: cte(["profiles"]).rstrip() + ",\n" + UPSERT_SQL)
def profile_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K7: bulk load (seq 1) then an update batch (seq 2); newest seq wins."""
    p = T.profiles(spark, sf).select("user_id", "bmi")
    seg = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    upd = (p.join(seg, "user_id").where(F.col("c_mktsegment") == "BUILDING")
            .select("user_id", (F.col("bmi") + F.lit(1.0)).alias("bmi"), F.lit(2).alias("load_seq")))
    cur = p.withColumn("load_seq", F.lit(1))
    return upsert(cur, upd, "user_id", "load_seq").select("user_id", "bmi", "load_seq")


@register("profile_lookup", lambda: cte(["profiles", "vitals"]) + f"""
SELECT {', '.join(PROFILE_COLS)} FROM profiles WHERE user_id IN (SELECT user_id FROM vitals)""")
def profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """S8 in bulk: the profiles of every user seen in the vitals (semi join)."""
    users = T.vitals(spark, sf).select("user_id")
    return FL.keep_with_key_in(T.profiles(spark, sf), users, "user_id").select(*PROFILE_COLS)


@register("profile_split", lambda: cte(["profiles"]) + """
SELECT user_id, CASE WHEN row_number() OVER (ORDER BY user_id) <= 100 THEN 'bulk' ELSE 'stream' END AS part
FROM profiles""")
def profile_split(spark: SparkSession, sf: str) -> DataFrame:
    """first 100 profiles by id to the bulk load, the rest to the stream."""
    p = T.profiles(spark, sf).select("user_id")
    head, rest = FL.split_first_n(p, 100, ["user_id"])
    return head.withColumn("part", F.lit("bulk")).unionByName(rest.withColumn("part", F.lit("stream")))


# ============================================================== P7 P8 P10-P12 P16 P18 P23 P4 P15
@register("prop_clean", lambda: cte(["readings"]) + f"SELECT reading_id, municipality_id, {', '.join(READING_VALUES)} FROM readings")
def prop_clean(spark: SparkSession, sf: str) -> DataFrame:
    """All-string key/value records ('nan' for missing) -> typed doubles."""
    r = T.readings(spark, sf)
    m = r.select("reading_id", "municipality_id", P.to_string_map(r, READING_VALUES).alias("h"))
    return m.select("reading_id", "municipality_id",
                    *[P.number_or_null(F.col("h")[c]).alias(c) for c in READING_VALUES])


@register("fill_defaults", lambda: cte(["readings"]) + f"""
SELECT reading_id, municipality_id, {', '.join(f'coalesce({p}, 0.0) AS {p}' for p in K.POLLENS)} FROM readings""")
def fill_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Absent keys in a record count as 0.0."""
    r = T.readings(spark, sf)
    m = r.select("reading_id", "municipality_id",
                 F.map_filter(P.to_string_map(r, K.POLLENS), lambda k, v: v != F.lit("nan")).alias("h"))
    return m.select("reading_id", "municipality_id", *[P.number_or_zero(F.col("h")[p]).alias(p) for p in K.POLLENS])


@register("rename_drop_round", lambda: cte(["readings"]) + """
SELECT municipality_id, ts, temperature_2m AS temperature_c, precipitation AS precipitation_mm,
       round_even(pm10 * 10.0, 0) / 10.0 AS pm10, round_even(pm2_5 * 10.0, 0) / 10.0 AS pm2_5 FROM readings""")
def rename_drop_round(spark: SparkSession, sf: str) -> DataFrame:
    """P10 rename map, P11 drop, P12 one-decimal rounding (half to even)."""
    r = P.rename(T.readings(spark, sf), {"temperature_2m": "temperature_c", "precipitation": "precipitation_mm"})
    r = r.withColumns({"pm10": P.round_half_even("pm10", 1), "pm2_5": P.round_half_even("pm2_5", 1)})
    keep = ["municipality_id", "ts", "temperature_c", "precipitation_mm", "pm10", "pm2_5"]
    return r.drop(*[c for c in r.columns if c not in keep])


@register("add_missing", lambda: cte(["readings"]) + """
SELECT reading_id, municipality_id, temperature_2m, precipitation, 0.0e0 AS cloud_cover, 0.0e0 AS wind_speed_10m
FROM readings""")
def add_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Required model features absent from the data are added as 0."""
    r = T.readings(spark, sf).select("reading_id", "municipality_id", "temperature_2m", "precipitation")
    return P.add_missing(r, ["temperature_2m", "precipitation", "cloud_cover", "wind_speed_10m"])


@register("key_compose", lambda: cte(["readings"], [LATEST_SQL]) + """
SELECT 'municipality:' || CAST(municipality_id AS VARCHAR) AS key, municipality_id FROM latest""")
def key_compose(spark: SparkSession, sf: str) -> DataFrame:
    """P18 + S7: latest-state keys composed, scanned by prefix and parsed back."""
    keyed = latest_readings(spark, sf).select(P.site_key("municipality_id").alias("key"))
    scanned = keyed.where(F.col("key").startswith(K.SITE_KEY_PREFIX))
    return scanned.select("key", P.site_id_from_key("key").alias("municipality_id"))


@register("label_title", lambda: cte(["readings"], [LATEST_SQL]) + """
SELECT municipality_id, pollen_key,
       array_to_string(list_transform(string_split(replace(pollen_key, '_', ' '), ' '),
                                      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
FROM latest, (SELECT unnest(['alder_pollen','birch_pollen','grass_pollen','mugwort_pollen','olive_pollen',
                             'ragweed_pollen']) AS pollen_key) k
WHERE CASE pollen_key WHEN 'alder_pollen' THEN alder_pollen WHEN 'birch_pollen' THEN birch_pollen
      WHEN 'grass_pollen' THEN grass_pollen WHEN 'mugwort_pollen' THEN mugwort_pollen
      WHEN 'olive_pollen' THEN olive_pollen ELSE ragweed_pollen END IS NOT NULL""")
def label_title(spark: SparkSession, sf: str) -> DataFrame:
    """P23: 'alder_pollen' -> 'Alder Pollen' for every present latest value."""
    lat = latest_readings(spark, sf)
    pairs = ", ".join(f"'{p}', {p}" for p in K.POLLENS)
    long = lat.selectExpr("municipality_id", f"stack(6, {pairs}) AS (pollen_key, v)").where(F.col("v").isNotNull())
    return long.select("municipality_id", "pollen_key", S.pollen_label("pollen_key").alias("label"))


@register("year_date_parts", lambda: cte(["readings"]) + """
SELECT reading_id, municipality_id, CAST(year(ts) AS INTEGER) AS year, CAST(ts AS DATE) AS date,
       try_strptime(CASE WHEN mugwort_pollen IS NULL THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
                    '%Y-%m-%d %H:%M:%S') AS parsed_ts
FROM readings""")
def year_date_parts(spark: SparkSession, sf: str) -> DataFrame:
    """P4 year, P15 date and lenient text -> timestamp parse (junk -> NULL)."""
    r = T.readings(spark, sf)
    text = F.when(F.col("mugwort_pollen").isNull(), F.lit("n/a")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return r.select("reading_id", "municipality_id", P.year_of("ts").alias("year"),
                    F.to_date("ts").alias("date"), P.lenient_ts(text).alias("parsed_ts"))


# ============================================================== F1 F2 F4
NOT_NULL_ALL = " AND ".join(f"{c} IS NOT NULL" for c in READING_COLS)


@register("drop_null_rows", lambda: cte(["readings"]) + f"SELECT {', '.join(READING_COLS)} FROM readings WHERE {NOT_NULL_ALL}")
def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return FL.drop_null_rows(T.readings(spark, sf)).select(*READING_COLS)


@register("drop_null_subset", lambda: cte(["readings"]) + f"""
SELECT {', '.join(READING_COLS)} FROM readings WHERE mugwort_pollen IS NOT NULL""")
def drop_null_subset(spark: SparkSession, sf: str) -> DataFrame:
    return FL.drop_null_rows(T.readings(spark, sf), subset=["mugwort_pollen"]).select(*READING_COLS)


@register("common_sites", lambda: cte(["readings"]) + """
SELECT municipality_id FROM readings WHERE year(ts) = 2023
INTERSECT SELECT municipality_id FROM readings WHERE year(ts) = 2024""")
def common_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites present in both the 2023 and the 2024 source."""
    r = T.readings(spark, sf)
    return FL.common_keys(r.where(F.year("ts") == 2023), r.where(F.year("ts") == 2024), "municipality_id")


# ============================================================== J1 J2 J3 J10
def _air_feed(spark, sf):
    return FS.hourly_readings(spark, sf).select("municipality_id", "ts", "european_aqi", "pm10", "pm2_5", "ozone",
                                                "temperature_2m")


def _weather_feed(spark, sf):
    """A feed of its own source (orders), so some keys have no partner in the air-quality feed."""
    o = T.table(spark, sf, "orders")
    return (o.groupBy((F.col("o_custkey") % 100 + 1).alias("municipality_id"),
                      F.timestamp_seconds(F.lit(T.READINGS_EPOCH) + (F.col("o_orderkey") % 864) * 3600).alias("ts"))
             .agg((F.min("o_totalprice") / F.lit(1e4)).alias("temperature_2m"),
                  F.count(F.lit(1)).cast("double").alias("precipitation")))


FEEDS_SQL = ["""air AS (SELECT municipality_id, ts, european_aqi, pm10, pm2_5, ozone, temperature_2m FROM readings_hourly)""",
             """wx AS (SELECT o_custkey % 100 + 1 AS municipality_id,
                              make_timestamp((1703462400 + (o_orderkey % 864) * 3600) * 1000000) AS ts,
                              min(o_totalprice) / 1e4 AS temperature_2m, CAST(count(*) AS DOUBLE) AS precipitation
                       FROM orders GROUP BY 1, 2)"""]


@register("feed_merge", lambda: cte(["readings_hourly"], FEEDS_SQL) + """
SELECT a.municipality_id, a.ts, a.european_aqi, a.pm10, a.pm2_5, a.ozone, w.temperature_2m, w.precipitation
FROM air a JOIN wx w USING (municipality_id, ts)""")
def feed_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Air-quality feed + weather feed per (site, hour), weather wins."""
    merged, _ = J.merge_feeds(_air_feed(spark, sf), _weather_feed(spark, sf), ["municipality_id", "ts"])
    return merged.select("municipality_id", "ts", "european_aqi", "pm10", "pm2_5", "ozone", "temperature_2m",
                         "precipitation")


@register("feed_unmatched", lambda: cte(["readings_hourly"], FEEDS_SQL) + """
SELECT municipality_id, ts FROM air ANTI JOIN wx USING (municipality_id, ts)""")
def feed_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """J2 report: air-quality keys with no weather partner (instead of failing)."""
    _, unmatched = J.merge_feeds(_air_feed(spark, sf), _weather_feed(spark, sf), ["municipality_id", "ts"])
    return unmatched


@register("weather_pollen_join", lambda: cte(["readings_hourly"]) + f"""
SELECT w.municipality_id, w.ts, w.temperature_2m, w.precipitation, {', '.join('p.' + c for c in K.POLLENS)}
FROM readings_hourly w JOIN readings_hourly p USING (municipality_id, ts)""")
def weather_pollen_join(spark: SparkSession, sf: str) -> DataFrame:
    """Weather and pollen series joined on (site, hour)."""
    h = FS.hourly_readings(spark, sf)
    weather = h.select("municipality_id", "ts", "temperature_2m", "precipitation")
    pollen = h.select("municipality_id", "ts", *K.POLLENS)
    return J.weather_pollen(weather, pollen)


@register("site_valley", lambda: cte(["sites", "valleys"]) + """
SELECT s.municipality_id, s.name, v.valley FROM sites s JOIN valleys v USING (valley_id)""")
def site_valley(spark: SparkSession, sf: str) -> DataFrame:
    """Municipality -> valley lookup; unmatched rows dropped."""
    matched, _ = J.lookup(T.sites(spark, sf), T.valleys(spark, sf).select("valley_id", "valley"), "valley_id")
    return matched.select("municipality_id", "name", "valley")


REGISTRY_SQL = """registry AS (
  SELECT n.n_nationkey AS valley_id FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
  WHERE r.r_name <> 'MIDDLE EAST')"""


def model_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Valleys that have a model: all but one region's valleys."""
    n = T.table(spark, sf, "nation")
    r = T.table(spark, sf, "region")
    return (n.join(r, n["n_regionkey"] == r["r_regionkey"]).where(F.col("r_name") != "MIDDLE EAST")
             .select(F.col("n_nationkey").alias("valley_id")))


@register("site_unmatched", lambda: cte(["sites"], [REGISTRY_SQL]) + """
SELECT municipality_id, valley_id FROM sites ANTI JOIN registry USING (valley_id)""")
def site_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Sites whose valley has no model in the registry (error rows)."""
    _, missing = J.lookup(T.sites(spark, sf).select("municipality_id", "valley_id"), model_registry(spark, sf),
                          "valley_id")
    return missing


# ============================================================== J7 J8 valleys
INSIDE_SQL = """inside AS (
  SELECT p.lat, p.lng, min(v.valley_id) AS valley_id
  FROM (SELECT DISTINCT lat, lng FROM vitals) p JOIN valleys v
    ON p.lat >= v.lat_lo AND p.lat < v.lat_hi AND p.lng >= v.lng_lo AND p.lng < v.lng_hi
  GROUP BY p.lat, p.lng)"""


@register("point_in_valley", lambda: cte(["vitals", "valleys"]) + """
SELECT p.lat, p.lng, v.valley_id, v.valley
FROM (SELECT DISTINCT lat, lng FROM vitals) p JOIN valleys v
  ON p.lat >= v.lat_lo AND p.lat < v.lat_hi AND p.lng >= v.lng_lo AND p.lng < v.lng_hi""")
def point_in_valley_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every valley polygon containing each vitals position (ray casting)."""
    from airwell.operators.spatial import point_in_valley
    return point_in_valley(T.vitals(spark, sf), T.valleys(spark, sf)).select("lat", "lng", "valley_id", "valley")


@register("valley_fallback", lambda: cte(["vitals", "valleys"], [INSIDE_SQL]) + """
SELECT i.lat, i.lng, i.valley_id, v.valley, 'contains' AS method FROM inside i JOIN valleys v USING (valley_id)
UNION ALL
SELECT lat, lng, valley_id, valley, 'centroid' AS method FROM (
  SELECT p.lat, p.lng, v.valley_id, v.valley,
         row_number() OVER (PARTITION BY p.lat, p.lng ORDER BY
           round(sqrt(pow(p.lat - (v.lat_lo + v.lat_hi) / 2, 2) + pow(p.lng - (v.lng_lo + v.lng_hi) / 2, 2)), 9),
           v.valley_id) AS rn
  FROM (SELECT DISTINCT lat, lng FROM vitals ANTI JOIN inside USING (lat, lng)) p, valleys v) t
WHERE rn = 1""")
def valley_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """J7 + J8: containing valley, else the valley with the nearest centroid."""
    return valley_for_points(T.vitals(spark, sf), T.valleys(spark, sf)).select(
        "lat", "lng", "valley_id", "valley", "method")


# ============================================================== A2 A3 W1 W2 F7
DAILY_COLS = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen", "olive_pollen", "ragweed_pollen",
              "temperature_2m", "precipitation"]


def daily_cover(spark: SparkSession, sf: str) -> DataFrame:
    return W.daily_mean_with_cover(FS.hourly_readings(spark, sf, DAILY_COLS), "municipality_id", "ts", DAILY_COLS)


DAILY_SQL = "daily AS (SELECT municipality_id, CAST(ts AS DATE) AS date, " + ", ".join(
    f"CASE WHEN count({c}) >= count(*) / 2.0 THEN avg({c}) END AS {c}" for c in DAILY_COLS) + \
    " FROM readings_hourly GROUP BY ALL)"


@register("daily_mean_cover", lambda: cte(["readings_hourly"], [DAILY_SQL]) + f"""
SELECT municipality_id, date, {', '.join(f'{Q.fix6(c)} AS {c}' for c in DAILY_COLS)} FROM daily""")
def daily_mean_cover(spark: SparkSession, sf: str) -> DataFrame:
    """A2: hourly -> daily means with the half-coverage rule."""
    return daily_cover(spark, sf).select("municipality_id", "date", *[fix6(c).alias(c) for c in DAILY_COLS])


@register("daily_mean", lambda: cte(["readings_hourly"]) + f"""
SELECT municipality_id, CAST(ts AS DATE) AS date,
       make_timestamp(CAST(floor(avg(epoch(ts)) * 1e6) AS BIGINT)) AS time,
       {', '.join(f'{Q.fix6(f"avg({c})")} AS {c}' for c in DAILY_COLS)}
FROM readings_hourly GROUP BY ALL""")
def daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A3: plain daily means, the mean time kept as a timestamp."""
    h = FS.hourly_readings(spark, sf)
    aggs = [F.timestamp_micros(F.floor(F.avg(F.unix_seconds("ts")) * F.lit(1e6))).alias("time")]
    aggs += [fix6(F.avg(c)).alias(c) for c in DAILY_COLS]
    return h.groupBy("municipality_id", F.to_date("ts").alias("date")).agg(*aggs)


@register("lag_features", lambda: cte(["readings_hourly"], [DAILY_SQL]) + f"""
SELECT municipality_id, date, {Q.fix6('birch_pollen')} AS birch_pollen,
       {', '.join(f"{Q.fix6(f'lag(birch_pollen, {i}) OVER (PARTITION BY municipality_id ORDER BY date)')} AS birch_pollen_lag_{i}" for i in (1, 2, 3))}
FROM daily""")
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    """Lags 1-3 of the daily birch series, per site."""
    d = W.lags(daily_cover(spark, sf), "municipality_id", "date", "birch_pollen", 3)
    cols = ["birch_pollen"] + [f"birch_pollen_lag_{i}" for i in (1, 2, 3)]
    return d.select("municipality_id", "date", *[fix6(c).alias(c) for c in cols])


INTERP_SQL = """s AS (
  SELECT municipality_id, ts, mugwort_pollen AS v,
         row_number() OVER (PARTITION BY municipality_id ORDER BY ts) AS i FROM readings_hourly),
t AS (
  SELECT *, CASE WHEN v IS NOT NULL THEN i END AS vi FROM s),
u AS (
  SELECT municipality_id, ts, v, i,
    last_value(v IGNORE NULLS) OVER (PARTITION BY municipality_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    last_value(vi IGNORE NULLS) OVER (PARTITION BY municipality_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ip,
    first_value(v IGNORE NULLS) OVER (PARTITION BY municipality_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n,
    first_value(vi IGNORE NULLS) OVER (PARTITION BY municipality_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS inn
  FROM t)"""


@register("interpolate_fill", lambda: cte(["readings_hourly"], [INTERP_SQL]) + f"""
SELECT municipality_id, ts, {Q.fix6('''CASE WHEN v IS NOT NULL THEN v
  WHEN p IS NOT NULL AND n IS NOT NULL THEN p + (n - p) * CAST(i - ip AS DOUBLE) / CAST(inn - ip AS DOUBLE)
  WHEN p IS NULL THEN n ELSE p END''')} AS mugwort_filled
FROM u""")
def interpolate_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly mugwort gaps filled per site: linear inside, then bfill/ffill."""
    h = FS.hourly_readings(spark, sf).select("municipality_id", "ts", "mugwort_pollen")
    f = W.interpolate_fill(h, "municipality_id", "ts", "mugwort_pollen", "mugwort_filled")
    return f.select("municipality_id", "ts", fix6("mugwort_filled").alias("mugwort_filled"))


@register("today_row", lambda: cte(["readings_hourly"], [DAILY_SQL]) + f"""
SELECT municipality_id, date, {', '.join(f'{Q.fix6(c)} AS {c}' for c in DAILY_COLS)} FROM daily
QUALIFY row_number() OVER (PARTITION BY municipality_id ORDER BY date DESC) = 1""")
def today_row(spark: SparkSession, sf: str) -> DataFrame:
    """newest daily row per site."""
    d = latest_per_key(daily_cover(spark, sf), ["municipality_id"], ["date"])
    return d.select("municipality_id", "date", *[fix6(c).alias(c) for c in DAILY_COLS])


# ============================================================== R1-R7 indexes
@register("pollen_scores", lambda: cte(["readings"]) + f"""
SELECT reading_id, municipality_id, ts, {', '.join(f'{Q.pollen_score(p)} AS {p}_score' for p in K.POLLENS)},
       {Q.pei()} AS pei FROM readings""")
def pollen_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per-pollen scores and the Pollen Exposure Index per reading."""
    r = T.readings(spark, sf)
    return r.select("reading_id", "municipality_id", "ts",
                    *[S.pollen_score(p).alias(f"{p}_score") for p in K.POLLENS], S.pei().alias("pei"))


def _index_query(name: str, col_fn, sql_fn):
    @register(name, lambda: cte(["readings"]) + f"SELECT reading_id, municipality_id, ts, {sql_fn()} AS {name} FROM readings")
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return T.readings(spark, sf).select("reading_id", "municipality_id", "ts", col_fn().alias(name))
    q.__name__ = name
    return q


aqii_q = _index_query("aqii", S.aqii, Q.aqii)
opii_q = _index_query("opii", S.opii, Q.opii)
pmhi_q = _index_query("pmhi", S.pmhi, Q.pmhi)
ceri_q = _index_query("ceri", S.ceri, Q.ceri)


def scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_scores(FS.enriched_windows(spark, sf), with_list=True)


def _scored_sql(select: str) -> str:
    return FS.enriched_sql_prefix() + select


@register("risk_score", lambda: _scored_sql(f"""
SELECT user_id, window_end, {Q.air_impact()} AS air_impact, {Q.risk_score()} AS final_score FROM full_rows"""))
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    """R3 + R7: weighted air impact and personal risk per user window."""
    e = FS.enriched_windows(spark, sf)
    return e.select("user_id", "window_end", S.air_impact().alias("air_impact"), S.risk_score().alias("final_score"))


# ============================================================== R8-R15 advice, P21 P22 T9
@register("advice_general", lambda: _scored_sql(f"""
SELECT user_id, window_end, advice FROM (SELECT user_id, window_end, {Q.advice_general(Q.risk_score())} AS advice
FROM full_rows) t WHERE advice IS NOT NULL"""))
def advice_general(spark: SparkSession, sf: str) -> DataFrame:
    e = FS.enriched_windows(spark, sf).withColumn("final_score", S.risk_score())
    return (e.select("user_id", "window_end", S.advice_general("final_score").alias("advice"))
             .where(F.col("advice").isNotNull()))


def _long_advice(e: DataFrame, items: list[tuple[str, object]], label: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(k).alias(label), c.alias("advice")) for k, c in items])
    return (e.select("user_id", "window_end", F.explode(arr).alias("a"))
             .select("user_id", "window_end", f"a.{label}", "a.advice").where(F.col("advice").isNotNull()))


def _long_advice_sql(items: list[tuple[str, str]], label: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT user_id, window_end, {Q.q(k)} AS {label}, {sql} AS advice FROM full_rows" for k, sql in items)
    return _scored_sql(f"SELECT * FROM ({parts}) t WHERE advice IS NOT NULL")


@register("advice_pollen", lambda: _long_advice_sql([(p, Q.advice_pollen(p)) for p in K.POLLENS], "pollen"))
def advice_pollen(spark: SparkSession, sf: str) -> DataFrame:
    """Per-pollen advice for the user's allergies."""
    return _long_advice(FS.enriched_windows(spark, sf), [(p, S.advice_pollen(p)) for p in K.POLLENS], "pollen")


COND_SQL = [("asthma", Q.condition_advice("asthma_allergy", K.ASTHMA_TEXTS)),
            ("hay_fever", Q.condition_advice("hay_fever", K.HAY_FEVER_TEXTS)),
            ("eczema", Q.condition_advice("eczema", K.ECZEMA_TEXTS)), ("cardiac", Q.advice_cardiac())]


@register("advice_conditions", lambda: _long_advice_sql(COND_SQL, "condition"))
def advice_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """R10 + R11: asthma / hay fever / eczema from the allergic mean, cardiac."""
    items = [("asthma", S.advice_asthma()), ("hay_fever", S.advice_hay_fever()), ("eczema", S.advice_eczema()),
             ("cardiac", S.advice_cardiac())]
    return _long_advice(FS.enriched_windows(spark, sf), items, "condition")


@register("advice_vitals", lambda: _long_advice_sql(
    [("heart", Q.advice_heart()), ("skin", Q.advice_skin()), ("activity", Q.advice_activity())], "kind"))
def advice_vitals(spark: SparkSession, sf: str) -> DataFrame:
    """Wearable advice from the window means."""
    items = [("heart", S.advice_heart()), ("skin", S.advice_skin()), ("activity", S.advice_activity())]
    from airwell.operators.windows import vitals_window
    return _long_advice(vitals_window(T.vitals(spark, sf)), items, "kind")


ADVICE_LIST_SQL = """lists AS (
  SELECT user_id, window_start, window_end,
         list_filter([{parts}], lambda x: x IS NOT NULL) AS recs FROM full_rows),
items AS (
  SELECT user_id, window_start, window_end, CAST(generate_subscripts(recs, 1) - 1 AS INTEGER) AS pos,
         unnest(recs) AS advice FROM lists)"""


def _advice_list_prefix() -> str:
    parts = ", ".join(Q.advice_parts(Q.risk_score()))
    return FS.enriched_sql_prefix().rstrip() + ",\n" + ADVICE_LIST_SQL.replace("{parts}", parts) + "\n"


@register("advice_list", lambda: _advice_list_prefix() + "SELECT user_id, window_start, window_end, pos, advice FROM items")
def advice_list(spark: SparkSession, sf: str) -> DataFrame:
    """R15 + P22: ordered recommendation list, one row per entry."""
    s = scored_windows(spark, sf)
    return s.select("user_id", "window_start", "window_end", F.posexplode("recommendations").alias("pos", "advice"))


@register("category_latest", lambda: _advice_list_prefix() + """
SELECT user_id, category, arg_max(content, window_end) AS content, max(window_end) AS window_end FROM (
  SELECT user_id, window_end, trim(regexp_extract(advice, '^([^:]*):(.*)$', 1)) AS category,
         trim(regexp_extract(advice, '^([^:]*):(.*)$', 2)) AS content
  FROM items WHERE contains(advice, ':')) t
GROUP BY user_id, category""")
def category_latest(spark: SparkSession, sf: str) -> DataFrame:
    """P21 + T9: split 'Category: text'; per (user, category) the newest text."""
    s = scored_windows(spark, sf)
    return latest_by_category(advice_items(s, "user_id", "window_end"))


# ============================================================== R17-R19, J9
@register("pollen_class", lambda: cte(["readings"]) + """
SELECT reading_id, municipality_id, ts, pollen, """ + Q.pollen_class("pollen", "concentration") + """ AS level FROM (
  SELECT reading_id, municipality_id, ts, unnest(['Alder','Birch','Grass','Mugwort','Olive','Ragweed']) AS pollen,
         unnest([alder_pollen, birch_pollen, grass_pollen, mugwort_pollen, olive_pollen, ragweed_pollen]) AS concentration
  FROM readings) t""")
def pollen_class(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every reading's six pollen values (NULL counts as 0)."""
    r = T.readings(spark, sf)
    names = list(K.POLLEN_CLASS_BOUNDS)
    pairs = ", ".join(f"'{n}', {n.lower()}_pollen" for n in names)
    long = r.selectExpr("reading_id", "municipality_id", "ts", f"stack(6, {pairs}) AS (pollen, concentration)")
    return long.select("reading_id", "municipality_id", "ts", "pollen",
                       C.pollen_class("pollen", "concentration").alias("level"))


RISK_SQL = """risk AS (
  SELECT municipality_id, pollen, coalesce(concentration, 0.0) AS concentration,
         {cls} AS level
  FROM (SELECT municipality_id, unnest(['Alder','Birch','Grass','Mugwort','Olive','Ragweed']) AS pollen,
               unnest([alder_pollen, birch_pollen, grass_pollen, mugwort_pollen, olive_pollen, ragweed_pollen]) AS concentration
        FROM {src}) t)"""


def _risk_sql(src: str) -> str:
    return RISK_SQL.replace("{cls}", Q.pollen_class("pollen", "concentration")).replace("{src}", src)


@register("risk_table", lambda: cte(["readings"], [LATEST_SQL, _risk_sql("latest")]) + f"""
SELECT municipality_id, pollen, concentration, level, {Q.class_colour('level')} AS colour FROM risk""")
def risk_table(spark: SparkSession, sf: str) -> DataFrame:
    """R19 (with R17, R18): latest reading per site -> (site, pollen, level, colour)."""
    return C.risk_table(latest_readings(spark, sf)).select("municipality_id", "pollen", "concentration", "level", "colour")


@register("map_join", lambda: cte(["sites", "readings"], [LATEST_SQL, _risk_sql("latest")]) + f"""
SELECT s.municipality_id, l.pollen, coalesce({Q.class_colour('r.level')}, '#000000') AS colour
FROM sites s CROSS JOIN (SELECT unnest(['Alder','Birch','Grass','Mugwort','Olive','Ragweed']) AS pollen) l
LEFT JOIN risk r ON r.municipality_id = s.municipality_id AND r.pollen = l.pollen""")
def map_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every site x pollen layer coloured from the latest state, whatever
    its age; sites that never had a reading are black."""
    risk = C.risk_table(latest_readings(spark, sf))
    return J.map_colours(T.sites(spark, sf), risk).select("municipality_id", "pollen", "colour")


# ============================================================== A5 A6 A7 A8-A12
@register("class_share", lambda: cte(["profiles"]) + f"""
SELECT cad, count(*) AS n, {Q.fix6('count(*) / sum(count(*)) OVER ()')} AS share FROM profiles GROUP BY cad""")
def class_share(spark: SparkSession, sf: str) -> DataFrame:
    s = M.class_share(T.profiles(spark, sf), "cad")
    return s.select("cad", "n", fix6("share").alias("share"))


@register("flag_prevalence", lambda: cte(["profiles"]) + "SELECT " + ", ".join(
    f"{Q.fix6(f'avg(CAST({f} AS INTEGER))')} AS {f}" for f in FLAGS8) + " FROM profiles")
def flag_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    p = M.prevalence(T.profiles(spark, sf), FLAGS8)
    return p.select(*[fix6(f).alias(f) for f in FLAGS8])


@register("impute_mean", lambda: cte(["readings"]) + f"""
SELECT reading_id, municipality_id, ts,
       {Q.fix6('coalesce(mugwort_pollen, avg(mugwort_pollen) OVER ())')} AS mugwort_imputed FROM readings""")
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Missing mugwort values replaced by the column mean."""
    r = T.readings(spark, sf).select("reading_id", "municipality_id", "ts", "mugwort_pollen")
    i = M.impute_mean(r, ["mugwort_pollen"], suffix="_imp")
    return i.select("reading_id", "municipality_id", "ts", fix6("mugwort_pollen_imp").alias("mugwort_imputed"))


PERSIST_SQL = """pers AS (
  SELECT d.municipality_id, s.valley_id, d.date, d.{p} AS y,
         lag(d.{p}, 1) OVER (PARTITION BY d.municipality_id ORDER BY d.date) AS yhat
  FROM daily d JOIN sites s USING (municipality_id))"""


def _persistence(spark: SparkSession, sf: str, pollen: str) -> DataFrame:
    d = W.lags(daily_cover(spark, sf), "municipality_id", "date", pollen, 1)
    return (d.join(T.sites(spark, sf).select("municipality_id", "valley_id"), "municipality_id")
             .select("municipality_id", "valley_id", "date", F.col(pollen).alias("y"),
                     F.col(f"{pollen}_lag_1").alias("yhat")))


REG_SELECT = """count(*) AS n, {rmse} AS rmse, {mae} AS mae,
       {r2} AS r2"""


def _reg_sql_select() -> str:
    sst = "(var_pop(y) * count(*))"
    r2 = f"CASE WHEN {sst} > 0 THEN 1.0 - sum((y - yhat) * (y - yhat)) / {sst} END"
    return REG_SELECT.format(rmse=Q.fix6("sqrt(avg((y - yhat) * (y - yhat)))"), mae=Q.fix6("avg(abs(y - yhat))"),
                             r2=Q.fix6(r2))


@register("regression_metrics", lambda: cte(["sites", "readings_hourly"], [DAILY_SQL, PERSIST_SQL.format(p="birch_pollen")]) + f"""
SELECT valley_id, {_reg_sql_select()} FROM pers WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY valley_id""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """RMSE / MAE / R^2 of a persistence forecast of daily birch, per valley."""
    m = M.regression_metrics(_persistence(spark, sf, "birch_pollen"), "y", "yhat", ["valley_id"])
    return m.select("valley_id", "n", *[fix6(c).alias(c) for c in ("rmse", "mae", "r2")])


PERSIST_LONG_SQL = ["pers AS (" + " UNION ALL ".join(
    f"SELECT s.valley_id, '{p}' AS pollen, d.{p} AS y, lag(d.{p}, 1) OVER (PARTITION BY d.municipality_id ORDER BY d.date) AS yhat "
    "FROM daily d JOIN sites s USING (municipality_id)" for p in K.POLLENS) + ")",
    f"m AS (SELECT valley_id, pollen, {_reg_sql_select()} FROM pers WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY ALL)"]


@register("metrics_pivot", lambda: cte(["sites", "readings_hourly"], [DAILY_SQL, *PERSIST_LONG_SQL]) + "SELECT valley_id, " + ", ".join(
    f"max({m}) FILTER (pollen = '{p}') AS {p}_{m}" for p in K.POLLENS for m in ("rmse", "mae", "r2")) + " FROM m GROUP BY valley_id")
def metrics_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A10: RMSE, MAE and R^2 per valley (rows) x pollen (columns), in one
    pass: the six pollens are stacked to rows, lagged per (site, pollen),
    reduced once and pivoted."""
    d = daily_cover(spark, sf).select("municipality_id", "date", F.explode(F.array(
        *[F.struct(F.lit(p).alias("pollen"), F.col(p).alias("y")) for p in K.POLLENS])).alias("x")).select(
        "municipality_id", "date", "x.pollen", "x.y")
    w = Window.partitionBy("municipality_id", "pollen").orderBy("date")
    d = d.withColumn("yhat", F.lag("y", 1).over(w)) \
        .join(T.sites(spark, sf).select("municipality_id", "valley_id"), "municipality_id")
    names = ("rmse", "mae", "r2")
    wide = M.pivot_metrics(M.regression_metrics(d, "y", "yhat", ["valley_id", "pollen"]), "valley_id", "pollen",
                           K.POLLENS, list(names))
    return wide.select("valley_id", *[fix6(f"{p}_{m}").alias(f"{p}_{m}") for p in K.POLLENS for m in names])


@register("class_metrics", lambda: cte(["profiles"]) + f"""
SELECT count(*) AS n, CAST(sum(CASE WHEN asthma_allergy AND bmi > 25 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN NOT asthma_allergy AND bmi > 25 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN asthma_allergy AND NOT bmi > 25 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN NOT asthma_allergy AND NOT bmi > 25 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       {Q.fix6('(tp + tn) / CAST(count(*) AS DOUBLE)')} AS accuracy, {Q.fix6('tp / CAST(tp + fp AS DOUBLE)')} AS precision,
       {Q.fix6('tp / CAST(tp + fn AS DOUBLE)')} AS recall
FROM profiles""")
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy / precision / recall of 'bmi > 25' as a predictor of asthma."""
    p = T.profiles(spark, sf).withColumn("pred", F.col("bmi") > 25)
    m = M.class_metrics(p, "asthma_allergy", "pred")
    return m.select("n", "tp", "fp", "fn", "tn", *[fix6(c).alias(c) for c in ("accuracy", "precision", "recall")])


def _auc_sql(score: str, src: str = "profiles", label: str = "asthma_allergy") -> str:
    return f"""(SELECT sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM (
      SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT {score} AS s, sum(CAST({label} AS INTEGER)) AS pos, sum(1 - CAST({label} AS INTEGER)) AS neg
            FROM {src} GROUP BY 1) a) b)"""


@register("auc_exact", lambda: cte(["profiles"]) + f"""
SELECT CAST(sum(CAST(asthma_allergy AS INTEGER)) AS BIGINT) AS n_pos,
       CAST(sum(1 - CAST(asthma_allergy AS INTEGER)) AS BIGINT) AS n_neg,
       {Q.fix6(_auc_sql('bmi'))} AS auc FROM profiles""")
def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact ROC-AUC of bmi as a score for asthma (ties count half)."""
    a = M.auc_exact(T.profiles(spark, sf), "asthma_allergy", "bmi")
    return a.select(F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"),
                    fix6("auc").alias("auc"))


MODEL_SCORES = {"bmi": "bmi", "age": "CAST(age AS DOUBLE)", "bmi_x_age": "bmi * age"}


@register("best_model", lambda: cte(["profiles"]) + "SELECT arg_max(model, (auc, model)) AS best_model, max(auc) AS auc FROM (" +
    " UNION ALL ".join(f"SELECT {Q.q(k)} AS model, {Q.fix6(_auc_sql(v))} AS auc" for k, v in MODEL_SCORES.items()) + ") t")
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate score with the highest ROC-AUC."""
    p = T.profiles(spark, sf).select("asthma_allergy", "bmi", F.col("age").cast("double").alias("age"),
                                     (F.col("bmi") * F.col("age")).alias("bmi_x_age"))
    rows = None
    for k in MODEL_SCORES:
        a = M.auc_exact(p, "asthma_allergy", k).select(F.lit(k).alias("model"), fix6("auc").alias("auc"))
        rows = a if rows is None else rows.unionByName(a)
    return M.best_by(rows, "model", "auc")


# ============================================================== M1 M5 M7
@register("label_encode", """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type_idx
FROM events""")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """M1: alphabetical label encoding of a string column."""
    from airwell.operators.ml import label_encode as le
    e = T.table(spark, sf, "events").select("event_id", "event_type")
    return le(e, "event_type", "event_type_idx").select("event_id", "event_type", "event_type_idx")


@register("poly_features", lambda: cte(["profiles"]) + """
SELECT user_id, CAST(age AS DOUBLE) AS poly_0, CAST(age AS DOUBLE) * age AS poly_1, bmi AS poly_2,
       CAST(age AS DOUBLE) * bmi AS poly_3, bmi * bmi AS poly_4 FROM profiles""")
def poly_features(spark: SparkSession, sf: str) -> DataFrame:
    """M7: degree-2 polynomial expansion of (age, bmi)."""
    from airwell.operators.ml import poly2
    return poly2(T.profiles(spark, sf), ["age", "bmi"], "user_id")


@register("class_weights", lambda: cte(["profiles"]) + """
SELECT user_id, asthma_allergy AS label, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY asthma_allergy)) AS weight
FROM profiles""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """M5: balanced class weights n / (2 * n_class)."""
    from airwell.operators.ml import balanced_weights
    p = T.profiles(spark, sf).select("user_id", F.col("asthma_allergy").alias("label"))
    return balanced_weights(p, "label").select("user_id", "label", "weight")


# ============================================================== C1-C3 cohort
def _u_sql(key: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8)) AS BIGINT) / 4294967296.0)"


def _cohort_flags_sql() -> str:
    ecz = f"({_u_sql('user_id', 'eczema')} < {K.PROB_ECZEMA})"
    ast = (f"({_u_sql('user_id', 'asthma')} < CASE WHEN family_history_asthma THEN {K.PROB_ASTHMA_WITH_HISTORY} "
           f"ELSE {K.PROB_ASTHMA} END)")
    gate = f"({_u_sql('user_id', 'gate')} < {K.PROB_POLLEN_GATE})"
    cols = [f"{ecz} AS eczema", f"{ast} AS asthma_allergy"]
    for name, p in K.POLLEN_BASE_RATES:
        draw = f"({_u_sql('user_id', name)} < {p})"
        cols.append(f"CASE WHEN {ecz} OR {ast} THEN {gate} AND {draw} ELSE {draw} END AS {name}")
    return "flags AS (SELECT user_id, hay_fever, age, " + ", ".join(cols) + " FROM profiles)"


COHORT_FLAG_COLS = ["eczema", "asthma_allergy"] + [n for n, _ in K.POLLEN_BASE_RATES]


@register("cohort_flags", lambda: cte(["profiles"], [_cohort_flags_sql()]) + f"SELECT user_id, {', '.join(COHORT_FLAG_COLS)} FROM flags")
def cohort_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Repeatable allergy assignment from per-user hash draws."""
    from airwell.operators.cohort import assign_allergies
    return assign_allergies(T.profiles(spark, sf), "user_id").select("user_id", *COHORT_FLAG_COLS)


def _hayfever_sql() -> str:
    names = K.HAY_FEVER_PICK_ORDER
    none = "NOT (" + " OR ".join(names) + ")"
    pick = f"CAST(floor({_u_sql('user_id', 'pick')} * {len(names)}) AS INTEGER)"
    cols = [f"{n} OR (hay_fever AND {none} AND {pick} = {i}) AS {n}" for i, n in enumerate(names)]
    return f"SELECT user_id, hay_fever, {', '.join(cols)} FROM flags"


@register("cohort_hayfever", lambda: cte(["profiles"], [_cohort_flags_sql()]) + _hayfever_sql())
def cohort_hayfever(spark: SparkSession, sf: str) -> DataFrame:
    """Hay-fever cases get at least one pollen allergy."""
    from airwell.operators.cohort import assign_allergies, repair_hay_fever
    c = repair_hay_fever(assign_allergies(T.profiles(spark, sf), "user_id"), "user_id")
    return c.select("user_id", "hay_fever", *K.HAY_FEVER_PICK_ORDER)


@register("cohort_birthdate", lambda: cte(["profiles"]) + f"""
SELECT user_id, make_date(CAST(2024 - age AS INTEGER), m,
         CAST(floor({_u_sql('user_id', 'day')} * day(last_day(make_date(CAST(2024 - age AS INTEGER), m, 1)))) + 1 AS INTEGER))
       AS date_of_birth
FROM (SELECT user_id, age, CAST(floor({_u_sql('user_id', 'month')} * 12) + 1 AS INTEGER) AS m FROM profiles) t""")
def cohort_birthdate(spark: SparkSession, sf: str) -> DataFrame:
    """Birth date from age with a valid day of month (reference year 2024)."""
    from airwell.operators.cohort import birth_date
    return T.profiles(spark, sf).select("user_id", birth_date("user_id", "age", 2024).alias("date_of_birth"))


# import the modules that register further queries
from airwell.plans import queries_checks, queries_files, queries_forest, queries_grid, queries_history, queries_layers, queries_ml, queries_stream  # noqa: E402,F401
