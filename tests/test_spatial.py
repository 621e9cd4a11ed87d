"""Nearest site (J4) = brute force; point in polygon (J7); centroid."""

import math
import random

from pyspark.sql import functions as F

from airwell.functions.geo import haversine_km, ring_centroids
from airwell.operators.spatial import DEFAULT_LEVELS, nearest_site, point_in_valley, valley_for_points

R = 6371.0088


def hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(h, 1.0)))


def brute(points, sites, max_km=10000.0):
    out = {}
    for (la, ln) in points:
        best = min(((round(hav(la, ln, s[1], s[2]), 9), s[0], hav(la, ln, s[1], s[2])) for s in sites))
        if best[2] <= max_km:
            out[(la, ln)] = best[1]
    return out


def _check(spark, points, sites, **kw):
    p = spark.createDataFrame(points, "lat double, lng double")
    s = spark.createDataFrame(sites, "municipality_id long, latitude double, longitude double")
    got = {(r["lat"], r["lng"]): r["municipality_id"] for r in nearest_site(p, s, **kw).collect()}
    assert got == brute(points, sites)


def test_grid_equals_brute_force_dense_and_sparse(spark):
    rnd = random.Random(7)
    sites = [(i, 45.7 + rnd.random() * 1.3, 10.4 + rnd.random() * 2.0) for i in range(1, 301)]
    sites += [(1000, 45.9, 11.0), (999, 45.9, 11.0)]          # co-located: lowest id wins
    points = [(45.5 + rnd.random() * 1.8, 10.0 + rnd.random() * 2.8) for _ in range(200)]
    points += [(45.9, 11.0), (-33.9, 151.2), (64.1, -21.9)]  # on a site, far away (Sydney, Reykjavik)
    _check(spark, points, sites)
    _check(spark, points, sites, levels=DEFAULT_LEVELS)


def test_wraparound_and_poles(spark):
    sites = [(1, 10.0, 179.95), (2, 10.0, -170.0), (3, 89.9, 0.0), (4, -60.0, 20.0)]
    points = [(10.0, -179.99), (10.1, 179.0), (89.95, 120.0), (-59.0, 25.0), (0.0, 0.0)]
    _check(spark, points, sites)


def test_radius_limit(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "lat double, lng double")
    s = spark.createDataFrame([(1, 0.0, 10.0)], "municipality_id long, latitude double, longitude double")
    assert nearest_site(p, s, max_km=500.0).count() == 0
    assert nearest_site(p, s).count() == 1


def test_haversine_column(spark):
    df = spark.createDataFrame([(45.9, 11.0, 46.5, 11.35)], "a double, b double, c double, d double")
    v = df.select(haversine_km("a", "b", "c", "d")).first()[0]
    assert abs(v - hav(45.9, 11.0, 46.5, 11.35)) < 1e-9


def test_point_in_polygon_and_fallback(spark):
    # a concave "L" polygon and a triangle; rings are (lat, lng), closed
    ell = [[0.0, 0.0], [0.0, 2.0], [1.0, 2.0], [1.0, 1.0], [2.0, 1.0], [2.0, 0.0], [0.0, 0.0]]
    tri = [[5.0, 5.0], [5.0, 7.0], [7.0, 6.0], [5.0, 5.0]]
    v = spark.createDataFrame([(1, "ell", ell), (2, "tri", tri)], "valley_id long, valley string, ring array<array<double>>")
    pts = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (0.5, 1.5), (5.5, 6.0), (9.0, 9.0), (1.5, 0.5)],
                                "lat double, lng double")
    inside = {(r["lat"], r["lng"]): r["valley_id"] for r in point_in_valley(pts, v).collect()}
    assert inside == {(0.5, 0.5): 1, (0.5, 1.5): 1, (5.5, 6.0): 2, (1.5, 0.5): 1}
    res = {(r["lat"], r["lng"]): (r["valley_id"], r["method"]) for r in valley_for_points(pts, v).collect()}
    assert res[(9.0, 9.0)] == (2, "centroid")
    assert res[(1.5, 1.5)][1] == "centroid"
    assert len(res) == 6


def test_centroid_of_shapes(spark):
    sq = [[45.0, 10.0], [45.0, 10.4], [45.2, 10.4], [45.2, 10.0], [45.0, 10.0]]
    tri = [[0.0, 0.0], [0.0, 3.0], [3.0, 0.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1, sq), (2, tri)], "id long, ring array<array<double>>")
    c = {r["id"]: (r["c_lat"], r["c_lng"]) for r in ring_centroids(df, "id").collect()}
    assert abs(c[1][0] - 45.1) < 1e-12 and abs(c[1][1] - 10.2) < 1e-12
    assert abs(c[2][0] - 1.0) < 1e-12 and abs(c[2][1] - 1.0) < 1e-12


def test_dense_cluster_refines_first_level(spark):
    from airwell.operators.spatial import auto_levels
    rnd = random.Random(11)
    # a third of all sites inside a ~100 m patch, the rest spread over the region
    sites = [(i, 46.0 + rnd.random() * 0.001, 11.0 + rnd.random() * 0.001) for i in range(1, 301)]
    sites += [(1000 + i, 45.7 + rnd.random() * 1.3, 10.4 + rnd.random() * 2.0) for i in range(600)]
    s = spark.createDataFrame(sites, "municipality_id long, latitude double, longitude double")
    pos = s.select(F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lng")).distinct()
    levels = auto_levels(pos)
    assert levels[0][0] < 0.001
    points = [(46.0005, 11.0005), (46.01, 11.01), (45.8, 10.9), (46.9, 12.3)]
    _check(spark, points, sites)
