"""Polygon layers (S5, J7): parts, holes, odd input; placement = brute force."""

import json
import math
import os
import random

from airwell.operators.layers import points_in_shapes
from airwell.session import new_work_path
from airwell.sources import files as FI


def write_lines(spark, lines):
    path = new_work_path(spark, "t-layer")
    with open(os.path.join(path.replace("file:", ""), "layer.json"), "w") as f:
        f.writelines(x + "\n" for x in lines)
    return path


def feature(key, kind, coordinates):
    return json.dumps({"type": "Feature", "properties": {"com_istat_code_num": key, "name": "x"},
                       "geometry": {"type": kind, "coordinates": coordinates}})


def brute(points, shapes):
    out = set()
    for y, x in points:
        for key, rings in shapes.items():
            odd = False
            for ring in rings:
                for i, (ya, xa) in enumerate(ring):
                    yb, xb = ring[(i + 1) % len(ring)]
                    if (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa:
                        odd = not odd
            if odd:
                out.add((y, x, key))
    return out


def placed(spark, points, rings, **kw):
    p = spark.createDataFrame(points, "lat double, lng double")
    got = points_in_shapes(p, rings, **kw).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r["lat"], r["lng"], r["municipality_id"]) for r in got}


def test_layer_kinds_and_holes(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    path = write_lines(spark, [
        feature(1, "Polygon", [square(0, 10), square(4, 6)]),
        feature(2, "MultiPolygon", [[square(0, 2)], [square(5, 9), square(6, 7)]]),
        feature(3, "Point", [1, 2]),
        '{"type": "Feature", "properties": {"com_istat_code_num": 4}, "geometry": null}',
        '{"type": "Feature", "properties": {"com_istat_code_num": 5}, "geometry": {"type": "Polygon", "coordinates": "none"}}',
        feature(6, "Polygon", []),
    ])
    rings = FI.read_polygon_layer(spark, path)
    assert sorted((r["municipality_id"], r["part"], r["ring_no"]) for r in rings.collect()) == [
        (1, 0, 0), (1, 0, 1), (2, 0, 0), (2, 1, 0), (2, 1, 1)]
    got = placed(spark, [(1.0, 1.0), (4.5, 4.5), (5.5, 5.5), (6.5, 6.5), (8.0, 8.0), (20.0, 1.0), (1.0, 1.0), (None, 1.0)], rings, cell_deg=0.7)
    assert got == {(1.0, 1.0, 1), (1.0, 1.0, 2), (5.5, 5.5, 2), (6.5, 6.5, 1), (8.0, 8.0, 1), (8.0, 8.0, 2)}


def test_equal_to_brute_force(spark):
    rnd = random.Random(5)
    shapes = {}
    for key in range(25):
        cy, cx = rnd.uniform(-2, 2), rnd.uniform(-2, 2)
        star = lambda r, n: [(cy + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * i / n),
                              cx + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * i / n)) for i in range(n)]
        shapes[key] = [star(1.2, 17), star(0.3, 5), [(y + 2.0, x) for y, x in star(0.5, 6)]]
    # corners at points' own latitudes and on cell borders
    shapes[99] = [[(0.0, 0.0), (0.0, 1.0), (0.5, 1.0), (1.0, 0.5), (1.0, 0.0)]]
    points = [(rnd.uniform(-3, 4), rnd.uniform(-3, 3)) for _ in range(400)]
    points += [(0.5, 0.25 * i) for i in range(-1, 6)] + [(0.0, 0.5), (1.0, 0.25), (0.25, 0.0), (0.25, 1.0)]
    rows = [(k, [list(c) for c in ring]) for k, rings in shapes.items() for ring in rings]
    rings = spark.createDataFrame(rows, "municipality_id long, ring array<array<double>>")
    want = brute(points, shapes)
    assert len(want) > 300
    for cell in (0.05, 0.25, 3.0):
        assert placed(spark, points, rings, cell_deg=cell) == want


def test_odd_rings_and_empty_tables(spark):
    schema = "municipality_id long, lat double, ring array<array<double>>"
    nan = float("nan")
    rings = spark.createDataFrame([
        (1, 0.0, None), (2, 0.0, []), (3, 0.0, [[0.0, 0.0], [1.0, 1.0]]),
        (4, 0.0, [[0.0, 0.0], [0.0, None], None, [nan, 1.0], [0.0, 4.0], [4.0, 4.0], [4.0, 0.0]])], schema)
    assert placed(spark, [(1.0, 1.0), (5.0, 1.0)], rings) == {(1.0, 1.0, 4)}
    assert placed(spark, [(1.0, 1.0)], rings.limit(0)) == set()
    assert placed(spark, [], rings) == set()
