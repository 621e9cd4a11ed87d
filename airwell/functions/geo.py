"""Geometry as Column builders: great-circle distance, point in polygon,
polygon centroid.  Polygons are ``array<array<double>>`` rings of
(lat, lng) pairs, first point repeated at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from airwell.constants import EARTH_RADIUS_KM


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lng1, lat2, lng2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = F.radians(_c(lat2) - _c(lat1))
    dlmb = F.radians(_c(lng2) - _c(lng1))
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def guaranteed_radius_km(lat, ring_deg: float, cell_deg: float, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Lower bound of the distance from a point to any site outside the
    (2k+1)^2 grid cells around it, where ring_deg = k * cell_deg.

    A site outside the block differs by at least ring_deg in latitude or in
    longitude.  For the longitude case both latitudes lie within
    |lat| + ring_deg + cell_deg of the equator, so
    hav(d/R) >= cos^2(phi_max) * hav(ring), i.e.
    d >= 2R asin(cos(phi_max) sin(ring/2)); the latitude case gives R*ring,
    which is larger.
    """
    phi_max = F.least(F.abs(_c(lat)) + F.lit(ring_deg + cell_deg), F.lit(90.0))
    return (F.lit(2.0 * radius_km)
            * F.asin(F.cos(F.radians(phi_max)) * F.lit(math.sin(math.radians(ring_deg) / 2.0))))


def point_in_ring(lat, lng, ring) -> Column:
    """Even-odd ray casting over the ring's edges (J7), evaluated in the JVM
    with ``aggregate`` over the vertex array; no Python UDF."""
    r = _c(ring)
    y, x = _c(lat), _c(lng)
    n = F.size(r)
    edges = F.sequence(F.lit(0), n - 2)

    def step(acc, i):
        a, b = r[i], r[i + 1]
        ya, xa, yb, xb = a[0], a[1], b[0], b[1]
        crosses = ((ya > y) != (yb > y)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
        return F.when(crosses, ~acc).otherwise(acc)

    return F.when(n >= 4, F.aggregate(edges, F.lit(False), step)).otherwise(F.lit(False))


def ring_centroids(polygons, id_col: str, ring_col: str = "ring"):
    """Area centroid of every closed ring by the shoelace formula (J8):
    DataFrame (id, ring) -> (id, c_lat, c_lng).

    Vertices are exploded to rows, paired with their successor (``lead`` over
    the vertices of one polygon), taken relative to the polygon's first
    vertex for precision, and summed by an ordinary aggregation.  Degenerate
    rings (zero area) fall back to the vertex mean."""
    from pyspark.sql.window import Window
    v = polygons.select(id_col, F.posexplode(ring_col).alias("_i", "_p"))
    w = Window.partitionBy(id_col).orderBy("_i")
    v = (v.withColumn("_q", F.lead("_p").over(w))
          .withColumn("_o", F.first("_p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
          .withColumn("_n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    py, px = F.col("_p")[0] - F.col("_o")[0], F.col("_p")[1] - F.col("_o")[1]
    qy, qx = F.col("_q")[0] - F.col("_o")[0], F.col("_q")[1] - F.col("_o")[1]
    cross = px * qy - qx * py   # x_i*y_{i+1} - x_{i+1}*y_i with x=lng, y=lat
    last = F.col("_i") == F.col("_n") - 1   # closing vertex repeats the first
    g = (v.groupBy(id_col)
          .agg(F.sum(F.when(F.col("_q").isNotNull(), cross)).alias("_a2"),
               F.sum(F.when(F.col("_q").isNotNull(), (py + qy) * cross)).alias("_cy"),
               F.sum(F.when(F.col("_q").isNotNull(), (px + qx) * cross)).alias("_cx"),
               F.avg(F.when(~last, F.col("_p")[0])).alias("_my"), F.avg(F.when(~last, F.col("_p")[1])).alias("_mx"),
               F.first(F.col("_o")[0]).alias("_y0"), F.first(F.col("_o")[1]).alias("_x0")))
    a = F.col("_a2") / 2.0
    ok = F.abs(a) > F.lit(1e-15)
    return g.select(id_col,
                    F.when(ok, F.col("_y0") + F.col("_cy") / (6.0 * a)).otherwise(F.col("_my")).alias("c_lat"),
                    F.when(ok, F.col("_x0") + F.col("_cx") / (6.0 * a)).otherwise(F.col("_mx")).alias("c_lng"))


def ring_bbox(ring) -> Column:
    r = _c(ring)
    lats = F.transform(r, lambda p: p[0])
    lngs = F.transform(r, lambda p: p[1])
    return F.struct(F.array_min(lats).alias("lat_lo"), F.array_max(lats).alias("lat_hi"),
                    F.array_min(lngs).alias("lng_lo"), F.array_max(lngs).alias("lng_hi"))
