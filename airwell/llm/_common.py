"""Helpers shared by the operators: table access, global positions, crc."""

from __future__ import annotations

import io
import os
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.session import materialize, new_work_path

__all__ = ["materialize", "new_work_path", "read_table", "text_of", "global_position", "map_arrow", "values_of", "WHITE"]

# white space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return
WHITE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, a null text read as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def global_position(df: DataFrame, order: list, name: str, out: str = "pos") -> DataFrame:
    """``df`` in ``order``, range-partitioned, with a dense position from 0.

    Rows are range-partitioned and sorted in their partitions, so no task sees
    more than its range (list a unique column last to split equal keys).  The
    driver gets one row count per partition, nothing else.  The sorted rows are
    written first: a recomputed range partitioning could cut elsewhere.
    """
    mid = f"__{out}_mid"
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = materialize(sorted_rows.withColumn(mid, F.monotonically_increasing_id()), name)
    counts = t.groupBy(F.shiftright(mid, 33).alias("p")).count().orderBy("p").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["p"], total))
        total += r["count"]
    if not starts:
        return t.withColumn(out, F.lit(0).cast("long")).drop(mid)
    base = F.create_map(*[F.lit(x) for p, s in starts for x in (int(p), int(s))])
    return t.withColumn(out, F.element_at(base, F.shiftright(mid, 33))
                        + F.col(mid).bitwiseAND((1 << 33) - 1)).drop(mid)


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that
    they need not have it installed.  The archive lies in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_airwell_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = new_work_path(spark, "code") + "/airwell_code.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(data.getvalue())
    stream.close()
    context.addPyFile(path)
    context._airwell_shipped = True


def _releasing(fn):
    """``fn`` with Arrow's free memory given back at the end of a task: workers live on between tasks."""
    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
    return run


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    _ship(df.sparkSession)
    return df.mapInArrow(_releasing(fn), schema)


def values_of(column, rows: int = 256):
    """The values of an Arrow column, turned to Python objects a few rows at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()
