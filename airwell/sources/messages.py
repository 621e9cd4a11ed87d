"""Message-topic sources (S1) and their file-backed stand-in.

Production reads a broker topic with ``readStream.format("kafka")``; the
connector is not part of this build, so the tested path is a folder of files
with the same (key, value) rows, read as a file stream.  The parsing plan after
the source is identical.  What is published here is parquet, compressed and
still cut into splits by its readers: the values are JSON text that repeats the
field names in every message.  Folders of JSON lines are read as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.functions.prepare import ts_to_epoch
from airwell.session import list_names, new_work_path

MESSAGE_SCHEMA = "key STRING, value STRING"


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """S1 as deployed: latest offsets of a topic -> (key, value, ...)."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting)
            .load())


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 stand-in: a folder of (key, value) files as a stream."""
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(_format_of(spark, path)).load(path)


def _format_of(spark: SparkSession, path: str) -> str:
    """Of the files in a folder, or in the first of its ``batch=<id>`` folders."""
    names = list_names(spark, path)
    batches = sorted(n for n in names if n.startswith("batch="))
    if batches:
        names = list_names(spark, f"{path}/{batches[0]}")
    return "parquet" if any(n.endswith(".parquet") for n in names) else "json"


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).format(_format_of(spark, path)).load(path)


def write_messages(msgs: DataFrame, path: str, mode: str = "append") -> None:
    """Texts hardly repeat as a whole, so no dictionary of them is tried; row groups are small, as readers split at them."""
    msgs.write.mode(mode).option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").parquet(path)


def write_message_files(spark: SparkSession, msgs: DataFrame, name: str, files: int | None = None,
                        path: str | None = None) -> str:
    """Publish (key, value) rows as files below the shared folder."""
    path = path or new_work_path(spark, name)
    out = msgs.select("key", "value")
    if files:
        out = out.repartition(files)
    write_messages(out, path)
    return path


def reading_messages(readings: DataFrame, key: Column | None = None) -> DataFrame:
    """Readings as the producer sends them: ``timestamp`` in epoch seconds."""
    cols = [c for c in readings.columns]
    body = F.struct(*[ts_to_epoch(F.col(c)).alias("timestamp") if c == "ts" else F.col(c) for c in cols])
    k = key if key is not None else F.col("municipality_id").cast("string")
    return readings.select(k.alias("key"), F.to_json(body).alias("value"))


def vitals_messages(vitals: DataFrame) -> DataFrame:
    """Vitals as the wearable sends them: id, position, 5 signals, epoch ts."""
    body = F.struct(
        "event_id", F.col("user_id").cast("string").alias("id"), "heart_rate", "ibi", "eda", "skin_temp", "activity_level",
        "lat", "lng", ts_to_epoch(F.col("ts")).alias("timestamp"))
    return vitals.select(F.col("user_id").cast("string").alias("key"), F.to_json(body).alias("value"))


def publish_in_time_order(rows: DataFrame, encode, ts: str, path: str) -> str:
    """Simulated producer: publish ``rows`` as messages, range-partitioned by
    event time in one write.  Every file is a time range, the input decides
    how many there are, and nothing passes through one task.  Files of one
    write have no order among each other: a reader takes them in one
    micro-batch, or allows for their span in its watermark delay."""
    u = F.unix_micros(F.col(ts))
    write_messages(encode(rows.withColumn("_u", u).repartitionByRange("_u").drop("_u")).select("key", "value"), path)
    return path


def time_slices(rows: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """``rows`` in ``n`` equal spans of event time, for publishing one after the other.  The driver gets the
    first and the last time only."""
    u = F.unix_micros(F.col(ts))
    low, high = rows.agg(F.min(u), F.max(u)).first()
    if low is None:
        return [rows]
    part = F.expr(f"((unix_micros({ts}) - {low}L) * {n}L) div {high - low + 1}L")
    return [rows.where(part == i) for i in range(n)]
