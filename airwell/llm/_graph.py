"""Connected components of an edge table, as DataFrame joins.

Alternating large-star and small-star steps: each step is a grouped minimum
(combined on the map side) and a join back, so a hub with very many edges is
reduced before the shuffle and its rows may be split by the skew-join rule.
Every round is written to the shared folder; the driver sees only a count and
a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import materialize


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the smallest node reachable.

    Only nodes with an edge to another node are returned; loops and rows with a
    null end are ignored; an empty input gives an empty result."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .filter(F.col("a").isNotNull() & (F.col("a") > F.col("b"))).distinct()
    e = materialize(e, name)
    last = _checksum(e)
    while last[0]:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")) \
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")) \
            .select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct()
        e = materialize(small, name)
        now = _checksum(e)
        if now == last:
            break
        last = now
    nodes = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return nodes.union(nodes.select(F.col("component").alias("node"), F.col("component")).distinct())
