"""Bucketed history (K6): readings by year, bucketed by site, sorted by time.

A table of one folder per year, each cut into the same number of buckets by a
hash of ``site_slice``.  That column is the site and a slice number: the rows of
a site in a year are cut into slices of about ``slice_rows`` rows from the newest
hour on, so a site with a third of all rows lies in many buckets, while any other
is one slice in one bucket.  Slice 0 holds the newest rows, at least
``slice_rows`` of them or all.

Reading one site prunes years and buckets.  The newest rows per site and year
come from slice 0 alone and need no shuffle, as a bucket is read by one task.

Rows without a site or without a time are kept: a missing site is one site of
its own, rows without a time are one hour of the missing year.  The rows of one
site and hour stay in one slice.  An empty input gives an empty table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airwell.session import materialize, new_work_path

BUCKETS = 32
SLICE_ROWS = 1_000_000


@dataclass(frozen=True)
class BucketedHistory:
    """A table of the catalog, and the sites that have more than one slice."""
    table: str
    path: str
    buckets: int
    slice_rows: int
    key: str
    ts: str


def _site_slice(site: Column, number: Column) -> Column:
    return F.concat(F.coalesce(site.cast("string"), F.lit("")), F.lit("#"), number.cast("string"))


def hour_slices(rows: DataFrame, key: str, ts: str, slice_rows: int) -> DataFrame:
    """(site, year, hour, slice) of the hours that are not in their site's slice 0.

    Rows are counted per hour on the map side first; the running sums go over at
    most the hours of one year."""
    hours = rows.groupBy(F.col(key).alias("__site"), F.col("year").alias("__year"), F.date_trunc("hour", ts).alias("__hour")).count()
    newer = Window.partitionBy("__site", "__year").orderBy(F.col("__hour").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return hours.withColumn("__slice", F.floor(F.coalesce(F.sum("count").over(newer), F.lit(0)) / slice_rows).cast("int")) \
        .where(F.col("__slice") > 0).drop("count")


def write_bucketed_history(spark: SparkSession, rows: DataFrame, buckets: int = BUCKETS, slice_rows: int = SLICE_ROWS,
                           path: str | None = None, key: str = "municipality_id", ts: str = "ts") -> BucketedHistory:
    """Write ``rows`` (with a ``year`` column) as a bucketed table; ``site_slice`` and ``slice`` are added."""
    path = path or new_work_path(spark, "bucketed-history")
    cut = materialize(hour_slices(rows, key, ts, slice_rows), "history-slices")
    at = F.col(key).eqNullSafe(F.col("__site")) & F.col("year").eqNullSafe(F.col("__year")) \
        & F.date_trunc("hour", ts).eqNullSafe(F.col("__hour"))
    placed = rows.join(cut, at, "left").withColumn("slice", F.coalesce("__slice", F.lit(0))) \
        .withColumn("site_slice", _site_slice(F.col(key), F.col("slice"))).drop("__site", "__year", "__hour", "__slice")
    table = f"history_{uuid.uuid4().hex}"
    # the writer's bucket of a row is its partition here, so a bucket of a year is one file
    (placed.repartition(buckets, "site_slice").write.partitionBy("year").bucketBy(buckets, "site_slice")
     .sortBy("site_slice", ts).option("path", f"{path}/rows").format("parquet").saveAsTable(table))
    cut.groupBy("__site", "__year").agg((F.max("__slice") + 1).alias("slices")).toDF("site", "year", "slices") \
        .write.mode("overwrite").parquet(f"{path}/slices")
    return BucketedHistory(table, path, buckets, slice_rows, key, ts)


def open_bucketed_history(spark: SparkSession, history: BucketedHistory, table: str) -> BucketedHistory:
    """Enter the files of ``history`` in this session's catalog as ``table``, for a session whose catalog does not know them."""
    columns = spark.read.parquet(f"{history.path}/rows").schema
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(f"CREATE TABLE `{table}` ({listed}) USING parquet PARTITIONED BY (year) CLUSTERED BY (site_slice) "
              f"SORTED BY (site_slice, `{history.ts}`) INTO {history.buckets} BUCKETS LOCATION '{history.path}/rows'")
    spark.sql(f"ALTER TABLE `{table}` RECOVER PARTITIONS")
    return BucketedHistory(table, history.path, history.buckets, history.slice_rows, history.key, history.ts)


def history_of_site(spark: SparkSession, history: BucketedHistory, site, year: int) -> DataFrame:
    """The rows of one site and year, from the buckets of its slices only."""
    same = F.col("site").isNull() if site is None else F.col("site") == F.lit(site)
    n = spark.read.parquet(f"{history.path}/slices").where(same & (F.col("year") == year)).agg(F.max("slices")).first()[0] or 1
    slices = [f"{'' if site is None else site}#{i}" for i in range(n)]
    return spark.table(history.table).where((F.col("year") == year) & F.col("site_slice").isin(slices))


def newest_of_year(spark: SparkSession, history: BucketedHistory, n: int, order: list[str], years: list[int] | None = None) -> DataFrame:
    """The ``n`` newest rows per site and year with their rank (1 = newest), without a shuffle.

    ``order`` starts with the time; ``n`` is at most the rows of a slice."""
    if n > history.slice_rows:
        raise ValueError(f"slice 0 holds {history.slice_rows} rows of a site, {n} are wanted")
    if order[0] != history.ts:
        raise ValueError(f"the order starts with {history.ts}, by which the slices are cut")
    h = spark.table(history.table).where(F.col("slice") == 0)
    if years:
        h = h.where(F.col("year").isin(years))
    w = Window.partitionBy("year", "site_slice").orderBy(*[F.col(c).desc() for c in order])
    return h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
