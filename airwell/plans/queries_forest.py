"""The pollen forecast as tables: forests of all (valley, pollen) grown at once
(M10), stored as node rows (K10), scored by joins from the stored table (M9),
and the forecast of a position: valley by polygon or centroid (J7 / J8), its
model or an error row (J10), today and tomorrow (M11, W4).

The oracle grows the same trees in SQL, one chain of CTEs per level: features
are rounded to six decimals first and targets summed as whole millionths, so
both engines see the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.functions.scoring import fix6
from airwell.operators import filters as FL
from airwell.operators import forest as FO
from airwell.operators import metrics as M
from airwell.operators.asof import latest_per_key
from airwell.operators.joins import lookup
from airwell.operators.spatial import valley_for_points
from airwell.plans import sqlfrag as Q
from airwell.plans.catalog import register
from airwell.plans.queries import DAILY_SQL, INSIDE_SQL, cte
from airwell.plans.queries_checks import COMPLETE, FEATURES_SQL, LAGS, WEATHER, pollen_features
from airwell.session import materialize, new_work_path
from airwell.sources import tables as T

FEATURES = [*LAGS, *WEATHER]
GROUPS = ["valley_id", "pollen"]
# the small form that SQL can follow; the operators take any numbers
TREES, DEPTH, BINS = 3, 3, 8


def complete_features(spark: SparkSession, sf: str) -> DataFrame:
    """The complete feature rows of all (valley, pollen), rounded, with a key per row; written once."""
    full = FL.drop_null_rows(pollen_features(spark, sf), ["y", *FEATURES])
    return materialize(full.select(F.concat_ws("|", "municipality_id", "pollen", "date").alias("row_key"), "municipality_id", "date",
                                   *GROUPS, *[fix6(c).alias(c) for c in ("y", *FEATURES)]), "forecast-rows")


def fitted(rows: DataFrame) -> DataFrame:
    return FO.grow(rows, GROUPS, FEATURES, "y", F.col("row_key"), trees=TREES, depth=DEPTH, bins=BINS)


def stored(spark: SparkSession, rows: DataFrame) -> str:
    """Fit and store; what scores reads the stored table by its path alone."""
    path = new_work_path(spark, "pollen-models")
    FO.save_models(fitted(rows), path)
    return path


# ------------------------------------------------------------------ the oracle's side
ROWS_SQL = f"""full_rows AS (
  SELECT municipality_id || '|' || pollen || '|' || CAST(date AS VARCHAR) AS row_key, municipality_id, date, valley_id, pollen,
         {', '.join(f'{Q.fix6(c)} AS {c}' for c in ('y', *FEATURES))} FROM feats WHERE {COMPLETE})"""
TRAIN_SQL = """train_rows AS (
  SELECT * FROM full_rows WHERE CAST('0x' || substr(md5(row_key || ':split42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.8),
test_rows AS (SELECT * FROM full_rows ANTI JOIN train_rows USING (row_key))"""


def forest_sql(source: str, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, groups: list[str] = GROUPS,
               features: list[str] = FEATURES, min_leaf: str = "1") -> list[str]:
    """CTEs up to ``nodes``: the node table of the rows in ``source``."""
    by = ", ".join(groups)
    at = f"{by}, tree, node"
    u = "CAST('0x' || substr(md5(row_key || ':bag' || tree), 1, 8) AS BIGINT) / 4294967296.0"
    weight = "CASE " + " ".join(f"WHEN {u} >= {x!r} THEN {k}" for k, x in reversed(list(enumerate(FO.BAG_LIMITS, 1)))) + " ELSE 0 END"
    bin_of = lambda i, c: "(" + " + ".join(
        f"CASE WHEN {c} >= lo{i} + (hi{i} - lo{i}) * {k / bins!r}e0 THEN 1 ELSE 0 END" for k in range(1, bins)) + ")"
    out = [
        f"spans AS (SELECT {by}, {', '.join(f'min({c}) AS lo{i}, max({c}) AS hi{i}' for i, c in enumerate(features))} "
        f"FROM {source} GROUP BY ALL)",
        f"""bagged AS (SELECT r.*, tree, {weight} AS w FROM {source} r, range({trees}) t(tree))""",
        f"""level0 AS (SELECT {by}, tree, CAST(1 AS BIGINT) AS node, w, w * CAST(floor(y * 1e6 + 0.5) AS BIGINT) AS wy,
          {', '.join(f'{bin_of(i, c)} AS b{i}' for i, c in enumerate(features))} FROM bagged JOIN spans USING ({by}) WHERE w > 0)""",
        f"nodes0 AS (SELECT {at}, sum(w) AS n, sum(wy) AS s FROM level0 GROUP BY ALL)"]
    square = lambda s, n: f"CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / CAST({n} AS DOUBLE)"
    for d in range(depth):
        out += [
            f"hist{d} AS (" + " UNION ALL ".join(
                f"SELECT {at}, {i} AS feature, b{i} AS bin, sum(w) AS n, sum(wy) AS s FROM level{d} GROUP BY ALL" for i in range(len(features))) + ")",
            f"""run{d} AS (SELECT *, sum(n) OVER (PARTITION BY {at}, feature ORDER BY bin) AS n0, sum(s) OVER (PARTITION BY {at}, feature ORDER BY bin) AS s0,
              sum(n) OVER (PARTITION BY {at}, feature) AS nt, sum(s) OVER (PARTITION BY {at}, feature) AS st FROM hist{d})""",
            f"""best{d} AS (SELECT * FROM (SELECT *, nt - n0 AS n1, st - s0 AS s1,
                {square('s0', 'n0')} + {square('st - s0', 'nt - n0')} - {square('st', 'nt')} AS gain FROM run{d} WHERE nt > n0 AND n0 >= {min_leaf} AND nt - n0 >= {min_leaf}) x
              WHERE gain > 1e-12 * ({square('st', 'nt')})
              QUALIFY row_number() OVER (PARTITION BY {at} ORDER BY gain DESC, feature, bin) = 1)""",
            f"""nodes{d + 1} AS (SELECT {by}, tree, node * 2 AS node, n0 AS n, s0 AS s FROM best{d}
              UNION ALL SELECT {by}, tree, node * 2 + 1, n1, s1 FROM best{d})""",
            f"""level{d + 1} AS (SELECT l.* EXCLUDE (node), l.node * 2 + CASE WHEN
                (CASE feature {' '.join(f'WHEN {i} THEN b{i}' for i in range(len(features)))} END) > bin THEN 1 ELSE 0 END AS node
              FROM level{d} l JOIN best{d} USING ({at}))"""]
    low = " ".join(f"WHEN {i} THEN lo{i} + (hi{i} - lo{i}) * (CAST(bin + 1 AS DOUBLE) / {bins}e0)" for i in range(len(features)))
    name = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(features))
    out += [
        "every_node AS (" + " UNION ALL ".join(f"SELECT {at}, n, s FROM nodes{d}" for d in range(depth + 1)) + ")",
        "every_split AS (" + " UNION ALL ".join(f"SELECT {at}, feature, bin FROM best{d}" for d in range(depth)) + ")",
        f"""nodes AS (SELECT {by}, tree, node, CASE feature {name} END AS feature, CASE feature {low} END AS threshold,
            CASE WHEN feature IS NOT NULL THEN node * 2 END AS "left", CASE WHEN feature IS NOT NULL THEN node * 2 + 1 END AS "right",
            CAST(n AS BIGINT) AS n, (CAST(s AS DOUBLE) / CAST(n AS DOUBLE)) / 1e6 AS value
          FROM every_node e LEFT JOIN every_split x USING ({at}) JOIN spans p USING ({by}))"""]
    return out


def walk_sql(source: str, name: str, out: str, columns: str, depth: int = DEPTH) -> list[str]:
    """CTE ``name``: ``source`` with the mean of its group's trees as ``out`` (rows without a model are left out)."""
    x = "CASE n.feature " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in FEATURES) + " END"
    return [f"""{name}_walk AS (WITH RECURSIVE step AS (
        SELECT r.row_key, n.tree, CAST(1 AS BIGINT) AS node FROM {source} r JOIN nodes n ON n.valley_id = r.valley_id AND n.pollen = r.pollen AND n.node = 1
        UNION ALL
        SELECT r.row_key, n.tree, CASE WHEN {x} < n.threshold THEN n."left" ELSE n."right" END
        FROM step w JOIN {source} r USING (row_key) JOIN nodes n ON n.valley_id = r.valley_id AND n.pollen = r.pollen AND n.tree = w.tree AND n.node = w.node
        WHERE n.feature IS NOT NULL)
      SELECT w.row_key, (CAST(sum(CAST(floor(n.value * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE)) / 1e6 AS {out} FROM step w JOIN {source} r USING (row_key)
        JOIN nodes n ON n.valley_id = r.valley_id AND n.pollen = r.pollen AND n.tree = w.tree AND n.node = w.node
      WHERE n.feature IS NULL GROUP BY w.row_key)""",
            f"{name} AS (SELECT {columns}, {out} FROM {source} r JOIN {name}_walk USING (row_key))"]


def _sql(parts: list[str], select: str) -> str:
    return cte(["sites", "readings_hourly", "vitals", "valleys"], [DAILY_SQL, *FEATURES_SQL, ROWS_SQL, *parts]) + select


# ------------------------------------------------------------------ queries
@register("forest_nodes", lambda: _sql(forest_sql("full_rows"), f"""
SELECT valley_id, pollen, tree, node, feature, {Q.fix6('threshold')} AS threshold, "left", "right", n, {Q.fix6('value')} AS value FROM nodes"""))
def forest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """M10 + K10: the stored node table of one forest per (valley, pollen), all six pollens, read back."""
    nodes = FO.load_models(spark, stored(spark, complete_features(spark, sf)))
    return nodes.select(*GROUPS, "tree", "node", "feature", fix6("threshold").alias("threshold"), "left", "right", "n",
                        fix6("value").alias("value"))


@register("forest_score_stored", lambda: _sql(
    [TRAIN_SQL, *forest_sql("train_rows"), *walk_sql("test_rows", "scored", "p", "municipality_id, pollen, date, y")],
    f"SELECT municipality_id, pollen, date, y, {Q.fix6('p')} AS prediction FROM scored"))
def forest_score_stored(spark: SparkSession, sf: str) -> DataFrame:
    """M9 + K10 + J10: held-out days scored by joins with the stored models of their group."""
    rows = complete_features(spark, sf)
    train, test = FL.hash_split(rows, "row_key", [0.8, 0.2])
    path = stored(spark, train)
    known, _ = lookup(test, FO.load_models(spark, path).where("node = 1 AND tree = 0").select(*GROUPS), GROUPS)
    scored = FO.predict(known, FO.load_models(spark, path), GROUPS, FEATURES)
    return scored.select("municipality_id", "pollen", "date", "y", fix6("prediction").alias("prediction"))


@register("forecast_valley", lambda: _sql(
    [TRAIN_SQL, *forest_sql("train_rows"), *walk_sql("test_rows", "scored", "p", "valley_id, pollen, y")], f"""
SELECT valley_id, pollen, count(*) AS n, {Q.fix6('sqrt(avg((y - p) * (y - p)))')} AS rmse, {Q.fix6('avg(abs(y - p))')} AS mae FROM scored GROUP BY ALL"""))
def forecast_valley(spark: SparkSession, sf: str) -> DataFrame:
    """M10 + A8: held-out RMSE and MAE of the forest of every (valley, pollen)."""
    rows = complete_features(spark, sf)
    train, test = FL.hash_split(rows, "row_key", [0.8, 0.2])
    scored = FO.predict(test, FO.load_models(spark, stored(spark, train)), GROUPS, FEATURES).where("prediction IS NOT NULL")
    m = M.regression_metrics(scored, "y", "prediction", GROUPS)
    return m.select(*GROUPS, "n", fix6("rmse").alias("rmse"), fix6("mae").alias("mae"))


NEWEST_SQL = """newest AS (SELECT * FROM full_rows QUALIFY row_number() OVER (PARTITION BY municipality_id, pollen ORDER BY date DESC) = 1)"""
SHIFTED = "row_key, municipality_id, date, valley_id, pollen, today AS lag_1, lag_1 AS lag_2, lag_2 AS lag_3, temperature_2m, precipitation, today"
STEPS_SQL = lambda source: [
    *walk_sql(source, "first_step", "today", "r.*"), f"moved AS (SELECT {SHIFTED} FROM first_step)",
    *walk_sql("moved", "second_step", "tomorrow", "r.*")]


@register("forecast_two_step", lambda: _sql([*forest_sql("full_rows"), NEWEST_SQL, *STEPS_SQL("newest")], f"""
SELECT municipality_id, valley_id, pollen, date, {Q.fix6('today')} AS today, {Q.fix6('tomorrow')} AS tomorrow FROM second_step"""))
def forecast_two_step(spark: SparkSession, sf: str) -> DataFrame:
    """M11 + W4: every site's newest complete day (F7) scored by its own valley's stored models, then the shifted lags."""
    rows = complete_features(spark, sf)
    nodes = FO.load_models(spark, stored(spark, rows))
    newest = latest_per_key(rows, ["municipality_id", "pollen"], ["date"])
    out = FO.two_steps(newest, nodes, GROUPS, LAGS, WEATHER)
    return out.select("municipality_id", "valley_id", "pollen", "date", fix6("today").alias("today"), fix6("tomorrow").alias("tomorrow"))


# models of every valley but those whose number leaves 4 by 5: their positions get error rows
MODELLED = "valley_id % 5 <> 4"
POSITION_SQL = [
    INSIDE_SQL.replace("SELECT DISTINCT lat, lng FROM vitals", "SELECT DISTINCT latitude AS lat, longitude AS lng FROM sites"),
    """placed AS (SELECT lat, lng, valley_id FROM inside UNION ALL
      SELECT lat, lng, valley_id FROM (SELECT p.lat, p.lng, v.valley_id, row_number() OVER (PARTITION BY p.lat, p.lng ORDER BY
          round(sqrt(pow(p.lat - (v.lat_lo + v.lat_hi) / 2, 2) + pow(p.lng - (v.lng_lo + v.lng_hi) / 2, 2)), 9), v.valley_id) AS rn
        FROM (SELECT DISTINCT latitude AS lat, longitude AS lng FROM sites
              WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lat = latitude AND i.lng = longitude)) p, valleys v) t WHERE rn = 1)""",
    f"model_rows AS (SELECT * FROM full_rows WHERE {MODELLED})",
    *forest_sql("model_rows"), NEWEST_SQL,
    """at_position AS (SELECT n.* EXCLUDE (valley_id), p.valley_id FROM newest n JOIN sites s USING (municipality_id)
      JOIN placed p ON p.lat = s.latitude AND p.lng = s.longitude)""",
    *STEPS_SQL("at_position")]


@register("forecast_position", lambda: _sql(POSITION_SQL, f"""
SELECT municipality_id, valley_id, pollen, date, {Q.fix6('today')} AS today, {Q.fix6('tomorrow')} AS tomorrow, CAST(NULL AS VARCHAR) AS error FROM second_step
UNION ALL
SELECT municipality_id, valley_id, pollen, date, NULL, NULL, 'no model for ' || pollen || ' in valley ' || valley_id FROM at_position a
WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.valley_id = a.valley_id AND n.pollen = a.pollen)"""))
def forecast_position(spark: SparkSession, sf: str) -> DataFrame:
    """A position's valley by polygon or centroid (J7 / J8), its stored models or an error row (J10), today and tomorrow."""
    rows = complete_features(spark, sf)
    path = stored(spark, rows.where(MODELLED))
    nodes = FO.load_models(spark, path)
    sites = T.sites(spark, sf).select("municipality_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    valley = sites.join(valley_for_points(sites, T.valleys(spark, sf)), ["lat", "lng"]).select("municipality_id", "valley_id")
    newest = latest_per_key(rows, ["municipality_id", "pollen"], ["date"]).drop("valley_id").join(valley, "municipality_id")
    known, unmatched = lookup(newest, nodes.where("node = 1 AND tree = 0").select(*GROUPS), GROUPS)
    out = FO.two_steps(known, nodes, GROUPS, LAGS, WEATHER)
    out = out.select("municipality_id", "valley_id", "pollen", "date", fix6("today").alias("today"), fix6("tomorrow").alias("tomorrow"),
                     F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("double")
    return out.unionByName(unmatched.select(
        "municipality_id", "valley_id", "pollen", "date", none.alias("today"), none.alias("tomorrow"),
        F.concat(F.lit("no model for "), "pollen", F.lit(" in valley "), F.col("valley_id").cast("string")).alias("error")))
