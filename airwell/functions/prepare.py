"""Projections and scalar rules (P3-P23) as Column / DataFrame helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwell.constants import SITE_KEY_PREFIX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P3 / P4 / P15 ------------------------------------------------------------------
def epoch_to_ts(x) -> Column:
    """Epoch seconds (DOUBLE) -> TIMESTAMP, keeping fractions."""
    return F.timestamp_seconds(_c(x))


def ts_to_epoch(x) -> Column:
    """TIMESTAMP -> epoch seconds DOUBLE (microsecond precision)."""
    return F.unix_micros(_c(x)).cast("double") / F.lit(1e6)


def year_of(x) -> Column:
    return F.year(_c(x))


def lenient_ts(text, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Parse text to TIMESTAMP; unparsable text gives NULL (pandas coerce)."""
    return F.try_to_timestamp(_c(text), F.lit(fmt))


# P5 / P6 ------------------------------------------------------------------------
def to_message(df: DataFrame, key) -> DataFrame:
    """Row -> (key STRING, value JSON STRING), the message shape of a topic."""
    return df.select(_c(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


# P1 / P2 ------------------------------------------------------------------------
def parse_messages(msgs: DataFrame, schema, keep_key: bool = False) -> DataFrame:
    """(key, value BINARY|STRING) -> typed, flattened rows (PERMISSIVE)."""
    parsed = msgs.select(F.col("key").cast("string").alias("_key"),
                         F.col("value").cast("string").alias("_raw"),
                         F.from_json(F.col("value").cast("string"), schema).alias("_p"))
    cols = ["_p.*"] + (["_key", "_raw"] if keep_key else [])
    return parsed.select(*cols)


# P7 / P8 ------------------------------------------------------------------------
def number_or_null(text) -> Column:
    """'nan' / junk / NaN -> NULL, numeric text -> DOUBLE."""
    d = _c(text).try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def number_or_zero(text) -> Column:
    return F.coalesce(number_or_null(text), F.lit(0.0))


def to_string_map(df: DataFrame, cols: list[str], null_text: str = "nan") -> Column:
    """Row -> MAP<STRING,STRING> as a key-value store keeps it."""
    args = []
    for c in cols:
        args += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(null_text))]
    return F.create_map(*args)


# P9 -----------------------------------------------------------------------------
def int_flags_to_bool(df: DataFrame, keep: list[str]) -> DataFrame:
    """Every column not in ``keep`` becomes (x == 1); NULL -> false."""
    return df.select(*[F.col(c) if c in keep else F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
                       for c in df.columns])


# P10 / P11 / P12 -----------------------------------------------------------------
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def round_half_even(x, decimals: int = 1) -> Column:
    """numpy/pandas rounding: scale, round half to even on the binary value."""
    f = float(10 ** decimals)
    return F.rint(_c(x) * F.lit(f)) / F.lit(f)


# P13 / P14 ----------------------------------------------------------------------
def fix_value(x, wrong: str, right: str) -> Column:
    return F.when(_c(x) == F.lit(wrong), F.lit(right)).otherwise(_c(x))


def obesity_flag(bmi, threshold: float = 25.0, parity_inverted: bool = False) -> Column:
    """bmi > threshold.  ``parity_inverted`` reproduces the 0 = yes coding."""
    b = _c(bmi) > F.lit(threshold)
    if parity_inverted:
        return F.when(b, F.lit(0)).when(~b, F.lit(1))
    return b


# P16 ----------------------------------------------------------------------------
def add_missing(df: DataFrame, required: list[str], value: float = 0.0) -> DataFrame:
    missing = {c: F.lit(value) for c in required if c not in df.columns}
    return df.withColumns(missing) if missing else df


# P17 ----------------------------------------------------------------------------
def random_id() -> Column:
    return F.expr("uuid()")


def stable_id(*cols) -> Column:
    """Repeatable row identity: SHA-256 of the key columns."""
    return F.sha2(F.concat_ws("\u0001", *[_c(c).cast("string") for c in cols]), 256)


# P18 ----------------------------------------------------------------------------
def site_key(x) -> Column:
    return F.concat(F.lit(SITE_KEY_PREFIX), _c(x).cast("string"))


def site_id_from_key(k) -> Column:
    return F.split_part(_c(k), F.lit(":"), F.lit(2)).try_cast("bigint")


# P19 ----------------------------------------------------------------------------
def stamp(df: DataFrame, ts_value, name: str = "timestamp") -> DataFrame:
    return df.withColumn(name, F.lit(ts_value))


# P21 / P22 ----------------------------------------------------------------------
def split_category(text) -> tuple[Column, Column]:
    """'Category: text' -> (category, content), split at the first colon, trimmed."""
    t = _c(text)
    return (F.trim(F.regexp_extract(t, r"^([^:]*):(.*)$", 1)),
            F.trim(F.regexp_extract(t, r"^([^:]*):(.*)$", 2)))


def has_category(text) -> Column:
    return _c(text).contains(":")


# headers -------------------------------------------------------------------------
def snake_case(name: str) -> str:
    """'FamilyHistoryAsthma' -> 'family_history_asthma' (D10)."""
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    return s.strip("_").lower()


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake_case(c) for c in df.columns if snake_case(c) != c})
