"""Points in the shapes of a polygon layer (J7 for shapes of several parts with
holes).

A point is inside a shape if a ray to the east crosses the edges of all its
rings an odd number of times; a hole's edges undo those around it.  Shapes are
taken apart to edges, and an edge is put into the grid cells from which such a
ray can reach it: those of its own latitudes, from the shape's western bound to
the edge's eastern end.  A point meets the edges in its one cell (an
equi-join) and its crossings are counted per (point, shape).  No shape is held
whole by a row, and no point meets edges beyond its own latitudes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_edges(rings: DataFrame, shape: str, ring: str = "ring") -> DataFrame:
    """(shape, ya, xa, yb, xb) of every edge that a ray to the east can cross.

    Rings of fewer than three positions, and positions with a null or no finite
    number, are left out; a ring that is not closed is closed.  Level edges are
    never crossed."""
    def sound(p: Column) -> Column:
        low, high = F.lit(float("-inf")), F.lit(float("inf"))
        return F.coalesce((p[0] > low) & (p[0] < high) & (p[1] > low) & (p[1] < high), F.lit(False))
    r = rings.select(F.col(shape).alias("shape"), F.filter(ring, sound).alias("_r")).where(F.size("_r") >= 3)
    n = F.size("_r")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("_r")[i].alias("a"), F.col("_r")[(i + 1) % n].alias("b")))
    e = r.select("shape", F.explode(starts).alias("e"))
    e = e.select("shape", *[F.col(f"e.{end}")[i].alias(f"{axis}{end}") for end in "ab" for i, axis in enumerate("yx")])
    return e.where("ya <> yb")


def crosses(y: Column, x: Column) -> Column:
    """Does a ray from (y, x) to the east cross the edge of the row?"""
    ya, xa, yb, xb = (F.col(c) for c in ("ya", "xa", "yb", "xb"))
    return ((ya > y) != (yb > y)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)


def edge_cells(edges: DataFrame, cell_deg: float) -> DataFrame:
    """``edges`` with (cy, cx): one row per cell from which a ray can reach the edge."""
    g = F.lit(float(cell_deg))
    west = edges.groupBy("shape").agg(F.min(F.least("xa", "xb")).alias("_west"))
    e = edges.join(west, "shape")
    down = F.sequence(F.floor(F.least("ya", "yb") / g), F.floor(F.greatest("ya", "yb") / g))
    # one more cell to the east: the crossing's longitude is computed and may be rounded up
    across = F.sequence(F.floor(F.col("_west") / g), F.floor(F.greatest("xa", "xb") / g) + 1)
    return e.withColumn("cy", F.explode(down)).withColumn("cx", F.explode(across)).drop("_west")


def points_in_shapes(points: DataFrame, rings: DataFrame, shape: str = "municipality_id", lat: str = "lat", lng: str = "lng",
                     ring: str = "ring", cell_deg: float = 0.05) -> DataFrame:
    """Distinct (lat, lng) of ``points`` -> (lat, lng, shape) for every shape of
    ``rings`` (a row per ring, positions as (lat, lng)) that holds it.

    Points with a null and shapes without rings give no row.  A point on an
    edge belongs to the side that the half-open comparison gives it.  Hot
    places are reduced to distinct positions before the join; the counts are
    combined on the map side."""
    g = F.lit(float(cell_deg))
    p = (points.select(F.col(lat).cast("double").alias("p_lat"), F.col(lng).cast("double").alias("p_lng"))
         .where("p_lat IS NOT NULL AND p_lng IS NOT NULL").distinct()
         .withColumn("cy", F.floor(F.col("p_lat") / g)).withColumn("cx", F.floor(F.col("p_lng") / g)))
    hit = p.join(edge_cells(ring_edges(rings, shape, ring), cell_deg), ["cy", "cx"]).where(crosses(F.col("p_lat"), F.col("p_lng")))
    odd = hit.groupBy("p_lat", "p_lng", "shape").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return odd.select(F.col("p_lat").alias(lat), F.col("p_lng").alias(lng), F.col("shape").alias(shape))
