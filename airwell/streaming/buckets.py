"""Latest state in key buckets (K2, K8): a batch rewrites the buckets that its
keys fall into and no others.

Below a folder lie ``data/v=<batch>/bucket=<b>``, the buckets that a batch has
rewritten, and ``manifest/v=<batch>``, which names the batch that holds each
bucket's current rows.  Writing the manifest is the commit: readers see the
state before a batch or after it, whole.  The newest manifests are kept for
slow readers; buckets that none of them names are removed, so the folder holds
each bucket once and what the kept batches replaced.

What goes through the driver is bounded by the number of buckets, a parameter:
take so many that one bucket of the state fits a task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.operators.asof import latest_per_key
from airwell.session import _fs, list_names, new_work_path
from airwell.streaming.pipelines import KEPT_VERSIONS, parse_readings, snapshot_versions, split_rejects

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def read_manifest(spark: SparkSession, state: str, version: int | None = None) -> dict[int, int]:
    """{bucket: the batch that wrote its current rows}; of the newest commit by default."""
    if version is None:
        versions = snapshot_versions(spark, f"{state}/manifest")
        if not versions:
            return {}
        version = versions[-1]
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{state}/manifest/v={version}").collect()}


def _paths(state: str, entries) -> list[str]:
    return [f"{state}/data/v={version}/bucket={bucket}" for bucket, version in sorted(entries)]


def read_buckets(spark: SparkSession, state: str, only: list[int] | None = None) -> DataFrame | None:
    """The state, or its buckets ``only``; None while nothing is committed there."""
    entries = [(b, v) for b, v in read_manifest(spark, state).items() if only is None or b in only]
    return spark.read.option("mergeSchema", True).parquet(*_paths(state, entries)) if entries else None


def lookup_key(spark: SparkSession, state: str, key: str, value, buckets: int = BUCKETS, key_type: str = "bigint") -> DataFrame | None:
    """The row of one key, from its one bucket.  ``key_type`` is the key column's type: a bucket follows from
    the hash of the value in that type."""
    typed = spark.range(1).select(F.lit(value).cast(key_type).alias(key)).select(bucket_of(key, buckets).alias("b"))
    rows = read_buckets(spark, state, [typed.first()["b"]])
    return None if rows is None else rows.where(F.col(key) == F.lit(value))


def merge_batch(batch: DataFrame, batch_id: int, state: str, key: str, order: list[str], buckets: int = BUCKETS,
                keep: int = KEPT_VERSIONS) -> list[int]:
    """Merge a batch into the state; the buckets rewritten.

    Per key the row with the greatest ``order`` stays.  Rows without a key are
    left out; a batch without rows commits the state as it was; a batch that is
    not newer than the newest commit changes nothing (a replay).  ``batch`` is
    read twice, so the caller persists it."""
    spark = batch.sparkSession
    versions = snapshot_versions(spark, f"{state}/manifest")
    if versions and batch_id <= versions[-1]:
        return []
    rows = batch.where(F.col(key).isNotNull())
    touched = sorted(r["b"] for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    manifest = read_manifest(spark, state)
    if touched:
        held = [(b, manifest[b]) for b in touched if b in manifest]
        if held:
            rows = spark.read.option("mergeSchema", True).parquet(*_paths(state, held)).unionByName(rows, allowMissingColumns=True)
        newest = latest_per_key(rows, [key], order).withColumn("bucket", bucket_of(key, buckets))
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/data/v={batch_id}")
        manifest.update({b: batch_id for b in touched})
    table = spark.createDataFrame(sorted(manifest.items()), "bucket int, version long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/v={batch_id}")
    _retire(spark, state, [*versions, batch_id], keep)
    return touched


def _retire(spark: SparkSession, state: str, versions: list[int], keep: int) -> None:
    """Remove the manifests beyond the ``keep`` newest and the buckets that only they name; a removal that was
    broken off is completed by the next one, as a manifest goes after its buckets."""
    def remove(path: str) -> None:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    alive = {e for v in versions[-keep:] for e in read_manifest(spark, state, v).items()}
    for old in versions[:-keep]:
        dead = set(read_manifest(spark, state, old).items()) - alive
        for path in _paths(state, dead):
            remove(path)
        for version in {v for _, v in dead}:
            if not any(n.startswith("bucket=") for n in list_names(spark, f"{state}/data/v={version}")):
                remove(f"{state}/data/v={version}")
        remove(f"{state}/manifest/v={old}")


def run_bucketed_state(spark: SparkSession, source: str, base: str | None = None, buckets: int = BUCKETS,
                       max_files_per_trigger: int | None = 1, key: str = "municipality_id",
                       order=("ts", "reading_id", "pm10")) -> str:
    """Readings topic -> latest state in buckets, availableNow; malformed messages go to ``rejects/batch=<id>``."""
    from airwell.sources.messages import file_stream
    base = base or new_work_path(spark, "bucketed-state")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split_rejects(batch, key, "ts")
            bad.write.mode("overwrite").parquet(f"{base}/rejects/batch={batch_id}")
            merge_batch(good, batch_id, f"{base}/state", key, list(order), buckets)
        finally:
            batch.unpersist()

    q = (parse_readings(file_stream(spark, source, max_files_per_trigger)).writeStream.foreachBatch(run)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/state"
