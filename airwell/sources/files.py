"""File scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.constants import SITE_KEY_PREFIX


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """CSV with a header row and a declared schema (no inference pass)."""
    r = spark.read.option("header", header)
    if schema:
        r = r.schema(schema)
    return r.csv(path)


def read_csv_tagged(spark: SparkSession, path_glob: str, suffix: str, schema: str | None = None,
                    key: str = "municipality") -> DataFrame:
    """S3: many files in one scan; the key is taken from the file name
    ('{name}{suffix}') through the hidden ``_metadata`` column."""
    df = read_csv(spark, path_glob, schema)
    name = F.col("_metadata.file_name")
    pattern = "^(.*)" + suffix.replace(".", r"\.") + "$"
    return df.withColumn(key, F.regexp_extract(name, pattern, 1))


def polygon_rings(text_col: str = "boundary") -> F.Column:
    """S4: '[(lat, lon), ...]' text -> array<array<double>>."""
    return F.from_json(F.translate(F.col(text_col), "()", "[]"), "array<array<double>>")


def read_polygons(spark: SparkSession, path: str, name_col: str = "Valley",
                  text_col: str = "Boundary Coordinates") -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(F.col(name_col).alias("valley"),
                     F.from_json(F.translate(F.col(f"`{text_col}`"), "()", "[]"), "array<array<double>>").alias("ring"))


def read_geojson_features(spark: SparkSession, path: str, id_prop: str = "com_istat_code_num") -> DataFrame:
    """GeoJSON FeatureCollection -> one row per feature with its id."""
    doc = spark.read.option("multiLine", True).json(path)
    f = doc.select(F.explode("features").alias("f"))
    return f.select(F.col(f"f.properties.{id_prop}").alias("municipality_id"), F.col("f.geometry").alias("geometry"))


def scan_latest_state(snapshot: DataFrame, key_col: str = "key", prefix: str = SITE_KEY_PREFIX) -> DataFrame:
    """All entries of the latest-state table whose key has the prefix."""
    return snapshot.where(F.col(key_col).startswith(prefix))


def lookup_profile(profiles: DataFrame, user_id) -> DataFrame:
    """One profile by primary key (the filter reaches the parquet scan)."""
    return profiles.where(F.col("user_id") == F.lit(user_id))


def read_geojson_lines(spark: SparkSession, path: str, id_prop: str = "com_istat_code_num") -> DataFrame:
    """S5 for large layers: one GeoJSON feature per line (GeoJSON text
    sequence), read in parallel splits."""
    f = spark.read.schema(
        f"type string, properties struct<{id_prop}: bigint, name: string>, "
        "geometry struct<type: string, coordinates: array<double>>").json(path)
    return f.select(F.col(f"properties.{id_prop}").alias("municipality_id"), F.col("geometry").alias("geometry"))


def polygon_parts(geometry_type: F.Column, coordinates: F.Column) -> F.Column:
    """A geometry's coordinates as text -> its parts, each a list of rings
    (outline first, then holes) of [longitude, latitude] positions.  A Polygon
    has one part; null for other geometries and for text that is no such list."""
    nested = "array<array<array<array<double>>>>"
    text = (F.when(geometry_type == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]")))
            .when(geometry_type == "MultiPolygon", coordinates))
    return F.from_json(text, nested)


def read_polygon_layer(spark: SparkSession, path: str, id_prop: str = "com_istat_code_num") -> DataFrame:
    """Shapes of a layer with one GeoJSON feature per line, read in
    parallel splits -> (municipality_id, part, ring_no, ring) with a row per
    ring, positions as (lat, lng).  Features without a polygon give no row."""
    f = spark.read.schema(f"type string, properties struct<{id_prop}: bigint>, geometry struct<type: string, coordinates: string>").json(path)
    parts = f.select(F.col(f"properties.{id_prop}").alias("municipality_id"),
                     F.posexplode(polygon_parts(F.col("geometry.type"), F.col("geometry.coordinates"))).alias("part", "rings"))
    rings = parts.select("municipality_id", "part", F.posexplode("rings").alias("ring_no", "r"))
    return rings.select("municipality_id", "part", "ring_no", F.transform("r", lambda p: F.array(p[1], p[0])).alias("ring"))
