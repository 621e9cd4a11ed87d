"""Equi-join operators of the domain.

Dimension sides (valleys, model registry) are bounded by the number of
polygons / models, not by data volume; Catalyst's size estimate
(``autoBroadcastJoinThreshold``) decides whether they are broadcast, and the
plans fall back to sort-merge joins when they are large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell import constants as K


def weather_pollen(weather: DataFrame, pollen: DataFrame, keys=("municipality_id", "ts")) -> DataFrame:
    """Inner join on (site, time); an empty side gives no rows."""
    return weather.join(pollen, list(keys), "inner")


def merge_feeds(first: DataFrame, second: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge two feeds per key; on clashing column names the second feed
    wins.  Returns (merged rows, keys of ``first`` with no partner)."""
    clash = [c for c in second.columns if c in first.columns and c not in keys]
    a = first.drop(*clash)
    merged = a.join(second, keys, "inner")
    unmatched = first.select(*keys).join(second.select(*keys), keys, "left_anti")
    return merged, unmatched


def lookup(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Inner lookup plus the report of unmatched rows."""
    return df.join(dim, key, "inner"), df.join(dim.select(key), key, "left_anti")


def enrich_profile(df: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """Left lookup of the user's profile; ``has_profile`` counts misses."""
    p = profiles.withColumn("has_profile", F.lit(True))
    return df.join(p, key, "left").withColumn("has_profile", F.coalesce(F.col("has_profile"), F.lit(False)))


def map_colours(features: DataFrame, risk: DataFrame, key: str = "municipality_id") -> DataFrame:
    """Every feature x pollen layer; colour from the risk table, black
    where the site has no data."""
    layers = F.explode(F.array(*[F.lit(p) for p in K.POLLEN_CLASS_BOUNDS]))
    f = features.select(key, layers.alias("pollen"))
    r = risk.select(key, "pollen", "level", "colour")
    return (f.join(r, [key, "pollen"], "left")
             .withColumn("colour", F.coalesce(F.col("colour"), F.lit(K.NO_DATA_COLOUR))))
