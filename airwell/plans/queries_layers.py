"""Polygon layers (S5, J7): site shapes of two parts with a hole, written as
GeoJSON and read back, and the wearers' positions placed in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.operators.layers import points_in_shapes
from airwell.plans.catalog import register
from airwell.plans.queries import cte
from airwell.session import new_work_path
from airwell.sources import files as FI
from airwell.sources import tables as T

# (part, ring, corners as latitude and longitude offsets in hundredths of a degree from the site):
# a kite with a slanted hole, and a triangle to its north-east
SHAPE = (
    (0, 0, ((-21, 0), (0, 27), (23, 0), (0, -25))),
    (0, 1, ((-7, 1), (2, 9), (8, -3))),
    (1, 0, ((19, 21), (31, 33), (17, 41))),
)


def _ring_text(corners) -> F.Column:
    """A closed GeoJSON ring as text, around the row's latitude and longitude."""
    def corner(dy, dx):
        return F.concat(F.lit("["), (F.col("longitude") + F.lit(dx / 100.0)).cast("string"), F.lit(","),
                        (F.col("latitude") + F.lit(dy / 100.0)).cast("string"), F.lit("]"))
    return F.concat(F.lit("["), F.concat_ws(",", *[corner(*c) for c in (*corners, corners[0])]), F.lit("]"))


def write_site_layer(spark: SparkSession, sf: str) -> str:
    """The sites' shapes, one GeoJSON feature per line."""
    rings = [_ring_text(c) for _, _, c in SHAPE]
    both = F.concat(F.lit("[["), rings[0], F.lit(","), rings[1], F.lit("],["), rings[2], F.lit("]]"))
    line = F.concat(F.lit('{"type":"Feature","properties":{"com_istat_code_num":'), F.col("municipality_id").cast("string"),
                    F.lit('},"geometry":{"type":"MultiPolygon","coordinates":'), both, F.lit("}}"))
    path = new_work_path(spark, "site-shapes")
    T.sites(spark, sf).select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def _corners_sql() -> str:
    rows = [f"({part}, {ring}, {i}, {dy / 100.0!r}e0, {dx / 100.0!r}e0)"
            for part, ring, corners in SHAPE for i, (dy, dx) in enumerate((*corners, corners[0]))]
    return "(VALUES " + ", ".join(rows) + ") c(part, ring_no, i, dy, dx)"


CORNERS_SQL = "site_corners AS (SELECT municipality_id, part, ring_no, i, latitude + dy AS y, longitude + dx AS x FROM sites, " + _corners_sql() + ")"
EDGES_SQL = """site_edges AS (SELECT a.municipality_id, a.y AS ya, a.x AS xa, b.y AS yb, b.x AS xb
  FROM site_corners a JOIN site_corners b ON b.municipality_id = a.municipality_id AND b.part = a.part AND b.ring_no = a.ring_no AND b.i = a.i + 1)"""


@register("shape_layer_scan", lambda: cte(["sites"], [CORNERS_SQL]) + """
SELECT municipality_id, part, ring_no, count(*) AS n_corners, min(y) AS lat_lo, max(y) AS lat_hi, min(x) AS lng_lo, max(x) AS lng_hi
FROM site_corners GROUP BY ALL""")
def shape_layer_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The rings of a layer of shapes with several parts and holes."""
    rings = FI.read_polygon_layer(spark, write_site_layer(spark, sf))
    bound = lambda f, i: f(F.transform("ring", lambda p: p[i]))
    return rings.select("municipality_id", "part", "ring_no", F.size("ring").alias("n_corners"),
                        bound(F.array_min, 0).alias("lat_lo"), bound(F.array_max, 0).alias("lat_hi"),
                        bound(F.array_min, 1).alias("lng_lo"), bound(F.array_max, 1).alias("lng_hi"))


@register("point_in_shape", lambda: cte(["sites", "vitals"], [CORNERS_SQL, EDGES_SQL]) + """
SELECT p.lat, p.lng, e.municipality_id FROM (SELECT DISTINCT lat, lng FROM vitals) p
JOIN site_edges e ON (e.ya > p.lat) <> (e.yb > p.lat)
WHERE p.lng < (e.xb - e.xa) * (p.lat - e.ya) / (e.yb - e.ya) + e.xa
GROUP BY ALL HAVING count(*) % 2 = 1""")
def point_in_shape(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + J7: the site shapes that hold each position of a wearer."""
    rings = FI.read_polygon_layer(spark, write_site_layer(spark, sf))
    return points_in_shapes(T.vitals(spark, sf), rings)
