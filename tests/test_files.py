"""File scans on small hand-written files: S3 key from file name, S4 polygon
text, S5 GeoJSON FeatureCollection."""

import json
import os

from airwell.session import new_work_path
from airwell.sources import files as FI


def _local(path):
    return path.replace("file:", "")


def test_key_from_file_name(spark):
    d = _local(new_work_path(spark, "t-csv"))
    for name, rows in (("Trento", [("2024-01-01 10:00:00", 1.5)]), ("Bolzano", [("2024-01-01 11:00:00", 2.5),
                                                                                ("2024-01-01 12:00:00", 3.5)])):
        with open(os.path.join(d, f"{name}_weather.csv"), "w") as f:
            f.write("time,temperature_2m\n" + "".join(f"{t},{v}\n" for t, v in rows))
    df = FI.read_csv_tagged(spark, os.path.join(d, "*_weather.csv"), "_weather.csv",
                            "time string, temperature_2m double")
    got = sorted((r["municipality"], r["temperature_2m"]) for r in df.collect())
    assert got == [("Bolzano", 2.5), ("Bolzano", 3.5), ("Trento", 1.5)]


def test_polygon_text(spark):
    d = _local(new_work_path(spark, "t-poly"))
    with open(os.path.join(d, "valleys.csv"), "w") as f:
        f.write('Valley,Boundary Coordinates\n"Val A","[(45.9, 11.1), (46.1, 11.2), (46.0, 11.4), (45.9, 11.1)]"\n')
    r = FI.read_polygons(spark, os.path.join(d, "valleys.csv")).first()
    assert r["valley"] == "Val A" and len(r["ring"]) == 4 and r["ring"][1] == [46.1, 11.2]


def test_geojson_feature_collection(spark):
    d = _local(new_work_path(spark, "t-geojson"))
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"com_istat_code_num": 21001}, "geometry": {"type": "Point", "coordinates": [11.3, 46.3]}},
        {"type": "Feature", "properties": {"com_istat_code_num": 21002}, "geometry": {"type": "Point", "coordinates": [11.2, 46.5]}}]}
    with open(os.path.join(d, "sites.geojson"), "w") as f:
        json.dump(doc, f, indent=2)
    ids = sorted(r["municipality_id"] for r in FI.read_geojson_features(spark, os.path.join(d, "sites.geojson")).collect())
    assert ids == [21001, 21002]


def test_hourly_rows_hold_what_is_asked_for(spark):
    from airwell.plans import flagship as FS
    from conftest import SF001
    some = FS.hourly_readings(spark, SF001, ["temperature_2m"])
    assert some.columns == ["municipality_id", "ts", "reading_id", "pm10", "temperature_2m"]
    every = FS.hourly_readings(spark, SF001).select(*some.columns)
    assert some.exceptAll(every).isEmpty() and some.count() == every.count()
