"""Token ids as ORC files in ascending document order.

Texts are range-partitioned and sorted by id, encoded in their partition and
written by Spark's ORC writer: run-length encoded integers in stripes, a row
index per stripe and Bloom filters on ``doc_id``.  Readers work stripe by
stripe in parallel and skip stripes and row groups by their metadata.

A row holds doc_id, start (ids of earlier rows of the same file), n_tokens and
ids (closed by the end id).  Files are ordered by their first document.

Defined edge results: a null or empty text is the end id alone; rows with equal
ids follow each other; null ids come first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airwell.llm._common import map_arrow, new_work_path, values_of
from airwell.llm._encode import encoder, rank_encoder

END_ID = 0
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
BATCH_IDS = 1 << 20     # ids handed to the writer at a time


def _encode_sorted(path: str):
    """Rows of a sorted partition with their ids, a bounded number of ids at a time."""
    def rows_of(doc_ids, data, start):
        n = np.array([len(d) + 1 for d in data[::2]], dtype=np.int64)
        ends = np.cumsum(n)
        ids = np.concatenate(data).view(np.int32)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(start + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
            names=["doc_id", "start", "n_tokens", "ids"]), start + int(ends[-1])

    def run(batches):
        start, end = 0, np.array([END_ID], dtype="<u4")
        encode = rank_encoder(path)
        if encode.core is None:
            encode = encoder(path)
        for batch in batches:
            first, data, held = 0, [], 0
            for i, ids in enumerate(encode.encode(values_of(batch.column(1), 32))):
                data += [ids, end]
                held += len(ids) + 1
                if held >= BATCH_IDS or i + 1 == batch.num_rows:
                    rows, start = rows_of(batch.column(0).slice(first, i + 1 - first), data, start)
                    yield rows
                    first, data, held = i + 1, [], 0
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the ORC files to ``path``."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = t.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(t.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), _encode_sorted(tokenizer),
                     f"doc_id {id_type}, start long, n_tokens long, ids array<int>")
    rows.write.mode("overwrite") \
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP)) \
        .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX_STRIDE)) \
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.compress", "SNAPPY").orc(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).orc(path).withColumn("file", F.col("_metadata.file_path"))


def _count_from_first(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` (file, start, ...) with ``start`` counted over all files: each
    file's total, from its two small columns, summed over the files before it."""
    files = stored.groupBy("file").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                       F.max(F.col("start") + F.col("n_tokens")).alias("total"))
    order = Window.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "file")
    base = files.select(F.col("file").alias("__f"), (F.sum("total").over(order) - F.col("total")).alias("__base"))
    return rows.join(base, F.col("file") == F.col("__f")).withColumn("start", F.col("__base") + F.col("start")) \
        .drop("file", "__f", "__base")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with ``start`` counted over all files."""
    stored = _stored(spark, path)
    return _count_from_first(stored, stored)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a stated id list; the pushed filter prunes stripes by statistics and Bloom filters."""
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).orc(path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _crc(batches):
    for batch in batches:
        ids = batch.column(3)
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        offsets = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files in ``path``, from their ids."""
    stored = _stored(spark, path)
    small = map_arrow(stored.select("file", "doc_id", "start", "ids"), _crc,
                      "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return _count_from_first(small, stored)


def round_trip(docs: DataFrame, tokenizer: str) -> str:
    """Write ``docs`` to a fresh shared folder and return it."""
    path = new_work_path(docs.sparkSession, "token-orc")
    write_tokens(docs, path, tokenizer)
    return path
