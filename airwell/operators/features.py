"""Hourly -> daily rollups (A2, A3) and time-series features.

Window functions here run over one row per (site, day) or (site, hour), i.e.
per-key series whose length is bounded by the time span, never by the number
of raw readings: rollups and per-(site, ts) reductions are aggregations with
map-side partial aggregation and come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_mean_with_cover(df: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """A2: per (key, date) mean of each column, NULL unless at least half of
    the rows have a value (non-null count >= total / 2)."""
    total = F.count(F.lit(1))
    aggs = [F.when(F.count(c) >= total / F.lit(2.0), F.avg(c)).alias(c) for c in cols]
    return df.groupBy(key, F.to_date(ts).alias("date")).agg(*aggs)


def daily_mean(df: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """A3: plain daily mean; the time column's mean is kept as a timestamp."""
    aggs = [F.timestamp_micros(F.avg(F.unix_micros(ts)).cast("bigint")).alias("time")]
    aggs += [F.avg(c).alias(c) for c in cols]
    return df.groupBy(key, F.to_date(ts).alias("date")).agg(*aggs)


def lags(df: DataFrame, key: str, order: str, col: str, k: int = 3) -> DataFrame:
    """Lags 1..k of ``col`` within each key's series (by row order)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{col}_lag_{i}": F.lag(col, i).over(w) for i in range(1, k + 1)})


def interpolate_fill(df: DataFrame, key: str, order: str, col: str, out: str | None = None) -> DataFrame:
    """Linear interpolation by row position inside each key's series,
    then backward fill (leading gap) and forward fill (trailing gap):
    v = p + (n - p) * (i - ip) / (in - ip)."""
    out = out or col
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    # the next value is the last one of the reversed order: a growing frame,
    # so both directions take one pass over the series
    back = Window.partitionBy(key).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(w)
    pos = F.when(F.col(col).isNotNull(), F.col("_i"))
    x = (df.withColumn("_i", i)
           .withColumn("_p", F.last(col, True).over(before))
           .withColumn("_ip", F.last(pos, True).over(before))
           .withColumn("_n", F.last(col, True).over(back))
           .withColumn("_in", F.last(pos, True).over(back)))
    inner = F.col("_p") + (F.col("_n") - F.col("_p")) * (F.col("_i") - F.col("_ip")).cast("double") \
        / (F.col("_in") - F.col("_ip")).cast("double")
    val = (F.when(F.col(col).isNotNull(), F.col(col))
           .when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), inner)
           .when(F.col("_p").isNull(), F.col("_n"))
           .otherwise(F.col("_p")))
    return x.withColumn(out, val).drop("_i", "_p", "_ip", "_n", "_in")


def feature_columns(columns: list[str], prefixes=("temperature", "precipitation")) -> list[str]:
    """Weather features chosen by name prefix."""
    return [c for c in columns if any(c.startswith(p) for p in prefixes)]


def shift_lags(lag_cols: list[str], new_value: Column) -> dict[str, Column]:
    """Next step's lags: lag1 <- new value, lag2 <- lag1, lag3 <- lag2."""
    out = {lag_cols[0]: new_value}
    for i in range(1, len(lag_cols)):
        out[lag_cols[i]] = F.col(lag_cols[i - 1])
    return out
