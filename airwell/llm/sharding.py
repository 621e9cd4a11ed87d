"""Sharding by a permutation-filled lookup table, DataFrame functions only.

Every shard prefers the slots of a prime-sized table in an order of its own
(offset and skip from hashes of its name); shards take turns, each claiming its
first free slot, until the table is full.  All shards get as many slots as the
others, give or take one, and few slots change owner when a shard leaves.

A row's key is hashed to a slot and the slot's owner is its shard: one lookup.
The table has ``table_size`` rows whatever the data, so its broadcast is
bounded by that parameter.  Keys are spread by hash; equal keys share a shard,
so shard by a unique key, or add a second column to the key, to split hot ones.

Defined edge results: a null key hashes as the empty string; repeated rows
share a shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
TABLE_SIZE = 6553           # a prime over 100 times the number of shards
MAX_TABLE_SIZE = 1_000_003  # the bound of what is broadcast: 16 bytes a row


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n ** 0.5) + 1))


def _number(s: str) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The owner (index into ``names``) of every slot."""
    if not names or not _is_prime(table_size) or not len(names) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError("a prime table size between the number of shards and MAX_TABLE_SIZE is needed")
    at = [_number(f"{s}/offset") % table_size for s in names]
    skip = [_number(f"{s}/skip") % (table_size - 1) + 1 for s in names]
    owner = [-1] * table_size
    for turn in range(table_size):
        i = turn % len(names)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % table_size
        owner[at[i]] = i
    return owner


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % table_size


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """(slot, shard): the table as a frame, from one literal."""
    text = F.lit(",".join(map(str, owner)))
    return spark.range(1).select(F.posexplode(F.split(text, ","))) \
        .select(F.col("pos").cast("long").alias("slot"), F.col("col").cast("long").alias("shard"))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(key, slot, shard) of every row."""
    owner = lookup_table([f"shard-{i}" for i in range(shards)], table_size)
    table = table_frame(docs.sparkSession, owner)
    rows = docs.select(F.col(key), slot_of(F.col(key), table_size).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS,
                 table_size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """``docs`` as Parquet in one folder per shard, each written by several tasks."""
    owner = lookup_table([f"shard-{i}" for i in range(shards)], table_size)
    table = table_frame(docs.sparkSession, owner).select(F.col("slot").alias("__slot"), F.col("shard").alias("shard_id"))
    rows = docs.join(F.broadcast(table), slot_of(F.col(key), table_size) == F.col("__slot")).drop("__slot")
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    rows.repartition("shard_id", part).write.mode("overwrite").partitionBy("shard_id").parquet(path)
