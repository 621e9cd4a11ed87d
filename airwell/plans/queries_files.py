"""File-format scans and writers (S3, S4, S5, K9) and the cohort clean-up
chain (C4, C5, P13, P14, P17) over data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.functions import prepare as P
from airwell.functions.geo import ring_bbox
from airwell.operators import cohort as CO
from airwell.operators import joins as J
from airwell.plans import flagship as FS
from airwell.plans.catalog import register
from airwell.plans.queries import DAILY_SQL, cte, daily_cover, latest_readings
from airwell.functions import classify as C
from airwell.functions.scoring import fix6
from airwell.plans import sqlfrag as Q
from airwell.session import new_work_path
from airwell.sinks.tables import write_csv, write_partitioned_by_valley
from airwell.sources import files as FI
from airwell.sources import tables as T


@register("multi_file_scan", lambda: cte(["readings_hourly"]) + """
SELECT municipality_id, ts, temperature_2m, precipitation FROM readings_hourly""")
def multi_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + U1 + K5: hourly weather written as one CSV folder per site; all
    folders read in one scan, the site taken from the file path, the time
    text parsed leniently (P15)."""
    h = FS.hourly_readings(spark, sf, ["temperature_2m", "precipitation"]).select(
        "municipality_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "temperature_2m", "precipitation")
    path = new_work_path(spark, "weather-csv")
    # one shuffle by site, so each site's folder gets one file
    (h.repartition("municipality_id").write.mode("overwrite").option("header", True)
      .partitionBy("municipality_id").csv(path))
    df = (spark.read.option("header", True).option("recursiveFileLookup", True)
          .schema("time string, temperature_2m double, precipitation double").csv(path))
    site = F.regexp_extract(F.col("_metadata.file_path"), r"municipality_id=([0-9]+)/", 1).cast("bigint")
    return df.select(site.alias("municipality_id"), P.lenient_ts("time").alias("ts"), "temperature_2m", "precipitation")


@register("polygon_text_scan", lambda: cte(["valleys"]) + """
SELECT valley_id, valley, lat_lo, lat_hi, lng_lo, lng_hi, 5 AS n_vertices FROM valleys""")
def polygon_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Valley rings written as '[(lat, lon), ...]' text in a CSV, read
    back and parsed into array<array<double>>."""
    v = T.valleys(spark, sf)
    pairs = F.transform("ring", lambda p: F.concat(F.lit("("), p[0].cast("string"), F.lit(", "),
                                                 p[1].cast("string"), F.lit(")")))
    text = F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))
    path = write_csv(spark, v.select("valley_id", "valley", text.alias("boundary")), "valley-rings")
    back = FI.read_csv(spark, path, "valley_id int, valley string, boundary string")
    ring = back.select("valley_id", "valley", FI.polygon_rings("boundary").alias("ring"))
    bb = ring.select("valley_id", "valley", ring_bbox("ring").alias("b"), F.size("ring").alias("n_vertices"))
    return bb.select("valley_id", "valley", "b.lat_lo", "b.lat_hi", "b.lng_lo", "b.lng_hi", "n_vertices")


RISK_FROM_LATEST = """latest AS (
  SELECT * FROM readings
  QUALIFY row_number() OVER (PARTITION BY municipality_id ORDER BY ts DESC, reading_id DESC, pm10 DESC) = 1),
risk AS (
  SELECT municipality_id, pollen, {cls} AS level
  FROM (SELECT municipality_id, unnest(['Alder','Birch','Grass','Mugwort','Olive','Ragweed']) AS pollen,
               unnest([alder_pollen, birch_pollen, grass_pollen, mugwort_pollen, olive_pollen, ragweed_pollen]) AS concentration
        FROM latest) t)"""


@register("map_join_geojson", lambda: cte(["sites", "readings"], [RISK_FROM_LATEST.replace(
    "{cls}", Q.pollen_class("pollen", "concentration"))]) + f"""
SELECT s.municipality_id, l.pollen, coalesce({Q.class_colour('r.level')}, '#000000') AS colour
FROM sites s CROSS JOIN (SELECT unnest(['Alder','Birch','Grass','Mugwort','Olive','Ragweed']) AS pollen) l
LEFT JOIN risk r ON r.municipality_id = s.municipality_id AND r.pollen = l.pollen""")
def map_join_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + J9: site features written as GeoJSON (one feature per line, so
    the scan splits), read back, coloured per pollen layer from the latest
    state; sites without data are black."""
    s = T.sites(spark, sf)
    feat = s.select(F.lit("Feature").alias("type"),
                    F.struct(F.col("municipality_id").alias("com_istat_code_num"), F.col("name").alias("name"))
                    .alias("properties"),
                    F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
                    .alias("geometry"))
    path = new_work_path(spark, "sites-geojson")
    feat.write.mode("overwrite").json(path)
    features = FI.read_geojson_lines(spark, path)
    risk = C.risk_table(latest_readings(spark, sf))
    return J.map_colours(features, risk).select("municipality_id", "pollen", "colour")


@register("valley_partitioned", lambda: cte(["sites", "valleys", "readings_hourly"], [DAILY_SQL]) + f"""
SELECT d.municipality_id, d.date, v.valley, {Q.fix6('d.birch_pollen')} AS birch_pollen
FROM daily d JOIN sites s USING (municipality_id) JOIN valleys v USING (valley_id)""")
def valley_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """K9: daily series written with one folder per valley, all read back."""
    d = daily_cover(spark, sf).join(T.sites(spark, sf).select("municipality_id", "valley_id"), "municipality_id")
    d = d.join(T.valleys(spark, sf).select("valley_id", "valley"), "valley_id")
    path = write_partitioned_by_valley(spark, d.select("municipality_id", "date", "valley", "birch_pollen"), "daily-by-valley")
    back = spark.read.parquet(path)
    return back.select("municipality_id", "date", "valley", fix6("birch_pollen").alias("birch_pollen"))


def _gender_text_sql() -> str:
    return ("CASE WHEN c.c_mktsegment = 'HOUSEHOLD' AND NOT p.gender THEN 'Fmale' "
            "WHEN p.gender THEN 'Male' ELSE 'Female' END")


@register("cohort_cleanup", lambda: cte(["profiles"]) + f"""
SELECT p.user_id, CASE WHEN {_gender_text_sql()} = 'Fmale' THEN 'Female' ELSE {_gender_text_sql()} END AS gender_text,
       p.bmi > 25 AS obesity, CASE WHEN p.bmi > 25 THEN 0 ELSE 1 END AS obesity_code,
       round_even(c.c_acctbal / 1000.0 * 10.0, 0) / 10.0 AS balance_k,
       CAST(round_even(least(greatest(c.c_acctbal / 10000.0, 0.0), 1.0), 0) AS INTEGER) AS balance_code,
       sha256(CAST(p.user_id AS VARCHAR) || chr(1) || c.c_mktsegment) AS row_key
FROM profiles p JOIN customer c ON c.c_custkey = p.user_id""")
def cohort_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """C4 + C5 + P11-P14 + P17: value correction ('Fmale' -> 'Female'),
    obesity flag (and the inverted 0 = yes code, D14), one-decimal rounding,
    clamped integer code, repeatable row key; drops the raw columns."""
    p = T.profiles(spark, sf).select("user_id", "gender", "bmi")
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_acctbal")
    x = p.join(c, "user_id")
    text = (F.when((F.col("c_mktsegment") == "HOUSEHOLD") & ~F.col("gender"), F.lit("Fmale"))
            .when(F.col("gender"), F.lit("Male")).otherwise(F.lit("Female")))
    x = x.withColumns({
        "gender_text": P.fix_value(text, "Fmale", "Female"),
        "obesity": P.obesity_flag("bmi"),
        "obesity_code": P.obesity_flag("bmi", parity_inverted=True),
        "balance_k": P.round_half_even(F.col("c_acctbal") / F.lit(1000.0), 1),
        "balance_code": CO.clamp_code(F.col("c_acctbal") / F.lit(10000.0)),
        "row_key": P.stable_id("user_id", "c_mktsegment"),
    })
    return x.drop("gender", "bmi", "c_mktsegment", "c_acctbal")


@register("risk_undefined", lambda: cte(["profiles"]) + f"""
SELECT user_id, {Q.allergic_count()} = 0 AND (asthma_allergy OR hay_fever OR eczema) AS risk_undefined FROM profiles""")
def risk_undefined(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose condition advice rests on an undefined mean (asthma,
    hay fever or eczema without any pollen allergy)."""
    from airwell.functions.scoring import risk_undefined as flag
    return T.profiles(spark, sf).select("user_id", flag().alias("risk_undefined"))
