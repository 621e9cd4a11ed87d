"""DuckDB-side views equal to ``airwell.sources.tables``.

These are the oracle's CTE prefix: the driver registers the raw tables as
views; each oracle query starts with ``WITH`` + the views it needs.
"""

from __future__ import annotations

VIEWS = {
    "sites": """
SELECT s_suppkey AS municipality_id, s_name AS name, s_nationkey AS valley_id,
       45.7e0 + ((s_suppkey * 37) % 131) * 1e-2 AS latitude,
       10.4e0 + ((s_suppkey * 53) % 197) * 1e-2 AS longitude
FROM supplier""",
    "readings": """
SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS reading_id, l_suppkey AS municipality_id,
       TIMESTAMP '2023-12-25 00:00:00' + INTERVAL 1 HOUR * (l_orderkey % 864) AS ts,
       l_quantity * 0.5e0 AS alder_pollen, l_discount * 1e3 AS birch_pollen, l_tax * 1e3 AS grass_pollen,
       CASE WHEN l_orderkey % 7 < 2 THEN NULL ELSE l_quantity END AS mugwort_pollen,
       l_discount * 1e2 AS olive_pollen, l_tax * 1e2 AS ragweed_pollen,
       l_quantity * 2e0 AS european_aqi, l_extendedprice / 1e3 AS pm10, l_extendedprice / 2e3 AS pm2_5,
       l_tax * 5e2 AS nitrogen_dioxide, l_discount * 2e2 AS sulphur_dioxide, l_quantity * 1e1 AS carbon_monoxide,
       l_extendedprice / 1e3 + 2e1 AS ozone, l_quantity - 1e1 AS temperature_2m, l_tax * 1e1 AS precipitation
FROM lineitem""",
    "profiles": """
SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS gender, 18 + c_custkey % 70 AS age,
       18e0 + (c_custkey % 170) / 1e1 AS bmi, c_custkey % 13 = 0 AS current_smoker,
       c_custkey % 5 = 1 AS family_history_asthma,
       c_custkey % 3 = 0 AS alder_pollen_allergy, c_custkey % 4 = 0 AS birch_pollen_allergy,
       c_custkey % 5 = 0 AS grass_pollen_allergy, c_custkey % 6 = 0 AS mugwort_pollen_allergy,
       c_custkey % 7 = 0 AS olive_pollen_allergy, c_custkey % 8 = 0 AS ragweed_pollen_allergy,
       c_custkey % 9 = 1 AS asthma_allergy, c_custkey % 10 = 1 AS hay_fever,
       c_custkey % 11 = 0 AS eczema, c_custkey % 12 = 0 AS cad
FROM customer""",
    "vitals": """
SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
       45e0 + value % 1e2 AS heart_rate, 1e3 / (45e0 + value % 1e2) AS ibi, 1e0 + value % 1e1 AS eda,
       33e0 + value % 6e0 AS skin_temp, (value % 1e2) / 1e2 AS activity_level,
       45.75e0 + ((user_id * 29) % 125) * 1e-2 AS lat, 10.45e0 + ((user_id * 41) % 189) * 1e-2 AS lng
FROM events""",
    "valleys": """
SELECT n_nationkey AS valley_id, n_name AS valley,
       45.7e0 + (n_nationkey % 5) * 0.28e0 AS lat_lo, 45.7e0 + (n_nationkey % 5) * 0.28e0 + 0.2e0 AS lat_hi,
       10.4e0 + FLOOR(n_nationkey / 5e0) * 0.4e0 AS lng_lo, 10.4e0 + FLOOR(n_nationkey / 5e0) * 0.4e0 + 0.3e0 AS lng_hi
FROM nation""",
    # latest reading per (site, hour): greatest (reading_id, pm10) wins
    "readings_hourly": """
SELECT * FROM readings
QUALIFY row_number() OVER (PARTITION BY municipality_id, ts ORDER BY reading_id DESC, pm10 DESC) = 1""",
}

ORDER = ["sites", "readings", "profiles", "vitals", "valleys", "readings_hourly"]


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they depend on)."""
    need = set(names)
    if "readings_hourly" in need:
        need.add("readings")
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in ORDER if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
