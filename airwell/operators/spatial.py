"""Spatial joins: nearest site (J4), point in valley (J7), nearest valley
centroid fallback (J8).

Nearest site is an exact k=1 search written as ordinary equi-joins on grid
cells, so it never forms all (point, site) pairs:

* sites are first reduced to distinct positions (lowest id wins, which is
  also the tie rule for equal distances), an aggregation;
* points are reduced to distinct positions too (many events share one);
* level by level, with growing cell sizes, each remaining point is joined to
  the sites in its 3x3 block of cells (the sites are repeated into the cells
  around them, the points keep one row).  Its best hit is final when it lies
  strictly inside the block's guaranteed radius; otherwise the point moves on
  to the next, coarser level;
* the last level's block covers the globe, so every point is resolved.  Only
  points with no site within thousands of kilometres ever reach it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.constants import NEAREST_RADIUS_KM
from airwell.session import materialize
from airwell.functions.geo import guaranteed_radius_km, haversine_km, point_in_ring, ring_bbox, ring_centroids

# (cell size in degrees, ring k).  The last level has 30-degree cells and
# k=6, i.e. the whole globe.
DEFAULT_LEVELS = ((0.05, 1), (0.2, 1), (0.8, 1), (3.2, 1), (12.8, 1), (30.0, 6))

RANK_DECIMALS = 9

# planar (degree) search for centroids: last level covers the globe
PLANAR_LEVELS = ((0.1, 1), (0.8, 1), (6.4, 1), (30.0, 6))


def _cells(lat, lng, g: float):
    ncx = int(math.ceil(360.0 / g))
    cy = F.floor((lat + F.lit(90.0)) / F.lit(g))
    cx = F.pmod(F.floor((lng + F.lit(180.0)) / F.lit(g)), F.lit(ncx))
    return cy, cx, ncx


def _planar(lat1, lng1, lat2, lng2):
    return F.sqrt(F.pow(F.col(lat1) - F.col(lat2), 2) + F.pow(F.col(lng1) - F.col(lng2), 2))


def _planar_guard(lat, ring_deg: float, cell_deg: float):
    return F.lit(float(ring_deg))


def auto_levels(pos: DataFrame, last=(30.0, 6), max_per_cell: int = 64) -> tuple:
    """Cell sizes from the targets' density: about two targets per cell on
    average, refined (4x finer, a few scalar jobs over the distinct target
    positions) until no cell holds more than ``max_per_cell`` targets, so a
    dense cluster cannot hand one point a huge candidate set on the first
    level; then 4x coarser per level up to the global block."""
    st = pos.agg(F.count(F.lit(1)).alias("n"), (F.max("s_lat") - F.min("s_lat")).alias("h"),
                 (F.max("s_lng") - F.min("s_lng")).alias("w")).first()
    n, h, w = st["n"] or 0, st["h"] or 0.0, st["w"] or 0.0
    area = max(h, 0.01) * max(w, 0.01)
    g = min(max(math.sqrt(2.0 * area / max(n, 1)), 0.001), last[0])
    for _ in range(8):
        cy, cx, _n = _cells(F.col("s_lat"), F.col("s_lng"), g)
        busiest = pos.groupBy(cy.alias("cy"), cx.alias("cx")).count().agg(F.max("count")).first()[0] or 0
        if busiest <= max_per_cell or g <= 1e-5:
            break
        g /= 4.0
    out = []
    while g < last[0] / 2:
        out.append((round(g, 9), 1))
        g *= 4
    out.append(last)
    return tuple(out)


def nearest_grid(points: DataFrame, targets: DataFrame, lat: str, lng: str, target_id: str,
                 target_lat: str, target_lng: str, metric: str = "haversine",
                 levels=None) -> DataFrame:
    """Exact nearest target per distinct point -> (p_lat, p_lng, site, dist).

    ``metric`` is "haversine" (km) or "planar" (degrees, as a flat plane).
    """
    dist_fn = (lambda: haversine_km("p_lat", "p_lng", "s_lat", "s_lng")) if metric == "haversine" \
        else (lambda: _planar("p_lat", "p_lng", "s_lat", "s_lng"))
    guard_fn = guaranteed_radius_km if metric == "haversine" else _planar_guard
    pos = (targets.where(F.col(target_lat).isNotNull() & F.col(target_lng).isNotNull())
           .groupBy(F.col(target_lat).alias("s_lat"), F.col(target_lng).alias("s_lng"))
           .agg(F.min(target_id).alias("s_id")))
    if levels is None:
        levels = auto_levels(pos, (30.0, 6) if metric == "haversine" else PLANAR_LEVELS[-1])
    remaining = (points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
                 .select(F.col(lat).alias("p_lat"), F.col(lng).alias("p_lng")).distinct())
    found = []
    for i, (g, k) in enumerate(levels):
        last = i == len(levels) - 1
        # the sites are repeated into the cells around them; a point keeps one
        # row and looks up its own cell, so the large side is shuffled once
        scy, scx, ncx = _cells(F.col("s_lat"), F.col("s_lng"), g)
        pcy, pcx, _ = _cells(F.col("p_lat"), F.col("p_lng"), g)
        offs = F.sequence(F.lit(-k), F.lit(k))
        s_l = (pos.withColumn("dy", F.explode(offs)).withColumn("dx", F.explode(offs))
               .select("s_id", "s_lat", "s_lng", (scy + F.col("dy")).alias("cy"),
                       F.pmod(scx + F.col("dx"), F.lit(ncx)).alias("cx"))
               .where((F.col("cy") >= 0) & (F.col("cy") <= math.ceil(180.0 / g))))
        if k * 2 + 1 >= ncx:   # block wraps around in longitude: avoid duplicate cells
            s_l = s_l.distinct()
        p_l = remaining.select("p_lat", "p_lng", pcy.alias("cy"), pcx.alias("cx"))
        # left join: points whose block is empty keep a row with no site
        cand = p_l.join(s_l, ["cy", "cx"], "left").withColumn("d", dist_fn())
        # rank key NULL for the empty-block row, so min_by skips it
        rank = F.when(F.col("d").isNotNull(), F.struct(F.round("d", RANK_DECIMALS), F.col("s_id")))
        best = (cand.groupBy("p_lat", "p_lng")
                .agg(F.min_by(F.struct(F.col("s_id").alias("site"), F.col("d").alias("dist")), rank).alias("b"))
                .select("p_lat", "p_lng", F.col("b.site").alias("site"), F.col("b.dist").alias("dist")))
        if last:
            found.append(best.where(F.col("site").isNotNull()))
            break
        # Materialise the level in the shared checkpoint folder: the next
        # level starts from a short plan, and levels nobody needs never run.
        best = materialize(best, "nearest-level")
        accept = F.col("dist") < guard_fn(F.col("p_lat"), k * g, g)
        found.append(best.where(accept))
        remaining = best.where(~F.coalesce(accept, F.lit(False))).select("p_lat", "p_lng")
        if remaining.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def site_levels(sites: DataFrame, site_lat: str = "latitude", site_lng: str = "longitude") -> tuple:
    """Grid levels for a site table (to reuse across many lookups)."""
    pos = sites.select(F.col(site_lat).alias("s_lat"), F.col(site_lng).alias("s_lng")).where(
        F.col("s_lat").isNotNull() & F.col("s_lng").isNotNull()).distinct()
    return auto_levels(pos)


def nearest_site(points: DataFrame, sites: DataFrame, lat: str = "lat", lng: str = "lng",
                 site_id: str = "municipality_id", site_lat: str = "latitude", site_lng: str = "longitude",
                 max_km: float = NEAREST_RADIUS_KM, levels=None) -> DataFrame:
    """Distinct (lat, lng) of ``points`` -> (lat, lng, site_id, distance_km).

    Ties in distance go to the lowest site id.  Points with no site within
    ``max_km`` get no row (inner semantics; left-join the result to keep them).
    """
    out = nearest_grid(points, sites, lat, lng, site_id, site_lat, site_lng, "haversine", levels)
    return (out.where(F.col("dist") <= F.lit(max_km))
            .select(F.col("p_lat").alias(lat), F.col("p_lng").alias(lng),
                    F.col("site").alias(site_id), F.col("dist").alias("distance_km")))


# --------------------------------------------------------------------------- J7
def point_in_valley(points: DataFrame, valleys: DataFrame, lat: str = "lat", lng: str = "lng",
                    cell_deg: float = 0.25) -> DataFrame:
    """Points x valley polygons -> (lat, lng, valley_id, valley) for every
    containing polygon.

    Polygons are keyed by every grid cell their bounding box overlaps; each
    point looks up its own cell (an equi-join), then the bounding box and the
    ray-casting test run as JVM expressions.  Polygon count and extent, not
    the number of points, bound the polygon side.
    """
    v = valleys.withColumn("bb", ring_bbox("ring"))
    g = F.lit(cell_deg)
    v = (v.withColumn("cy", F.explode(F.sequence(F.floor(F.col("bb.lat_lo") / g), F.floor(F.col("bb.lat_hi") / g))))
          .withColumn("cx", F.explode(F.sequence(F.floor(F.col("bb.lng_lo") / g), F.floor(F.col("bb.lng_hi") / g)))))
    p = (points.select(lat, lng).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct()
         .withColumn("cy", F.floor(F.col(lat) / g)).withColumn("cx", F.floor(F.col(lng) / g)))
    j = p.join(v, ["cy", "cx"])
    inside = (j.where((F.col(lat) >= F.col("bb.lat_lo")) & (F.col(lat) <= F.col("bb.lat_hi"))
                      & (F.col(lng) >= F.col("bb.lng_lo")) & (F.col(lng) <= F.col("bb.lng_hi")))
               .where(point_in_ring(F.col(lat), F.col(lng), F.col("ring"))))
    return inside.select(lat, lng, "valley_id", "valley")


# --------------------------------------------------------------------------- J8
def valley_for_points(points: DataFrame, valleys: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Containing valley, else the valley with the nearest area centroid
    (planar distance in degrees, as the original; ties -> lowest id).
    First containing valley wins when polygons overlap (lowest id)."""
    inside = (point_in_valley(points, valleys, lat, lng)
              .groupBy(lat, lng).agg(F.min_by(F.struct("valley_id", "valley"), F.col("valley_id")).alias("v"))
              .select(lat, lng, "v.valley_id", "v.valley", F.lit("contains").alias("method")))
    outside = (points.select(lat, lng).where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).distinct()
               .join(inside.select(lat, lng), [lat, lng], "left_anti"))
    cent = ring_centroids(valleys, "valley_id", "ring")
    best = nearest_grid(outside, cent, lat, lng, "valley_id", "c_lat", "c_lng", "planar")
    names = valleys.select("valley_id", "valley")
    near = (best.join(names, best["site"] == names["valley_id"])
            .select(F.col("p_lat").alias(lat), F.col("p_lng").alias(lng), "valley_id", "valley",
                    F.lit("centroid").alias("method")))
    return inside.unionByName(near)
