"""Grid search over hash folds (M4): folds, the AUC of every (combination,
fold) and the choice.  The small grid here is one that SQL can follow; the
operators take any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.operators import grid as G
from airwell.plans import sqlfrag as Q
from airwell.plans.catalog import register
from airwell.plans.queries import cte
from airwell.plans.queries_forest import forest_sql
from airwell.sources import tables as T

FOLDS = 5
GRID = {"trees": [1, 3], "depth": [1, 2, 3], "min_leaf": [1, 20]}
COLUMNS = ["age", "bmi", "gender", "current_smoker", "family_history_asthma", "eczema", "asthma_allergy"]


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.profiles(spark, sf).select(F.col("user_id").cast("string").alias("row_key"), *[F.col(c).cast("double").alias(c) for c in COLUMNS],
                                        F.col("hay_fever").cast("double").alias("y"))


FOLD_SQL = f"""least(CAST(floor(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':fold42'), 1, 8) AS BIGINT) / 4294967296.0 * {FOLDS}e0)
  AS INTEGER), {FOLDS - 1})"""


def _values(numbers: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({n})" for n in numbers) + ")"


def search_sql() -> list[str]:
    """CTEs up to ``per_fold``."""
    by = "trees, depth, min_leaf, fold"
    return [
        f"""grid_rows AS (SELECT CAST(user_id AS VARCHAR) AS row_key, {FOLD_SQL} AS own,
          {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in COLUMNS)}, CAST(hay_fever AS DOUBLE) AS y FROM profiles)""",
        f"""grid_train AS (SELECT r.*, CAST(fold AS INTEGER) AS fold, min_leaf FROM grid_rows r, range({FOLDS}) f(fold), {_values(GRID['min_leaf'])} m(min_leaf)
          WHERE fold <> own)""",
        *forest_sql("grid_train", max(GRID["trees"]), max(GRID["depth"]), groups=["fold", "min_leaf"], features=COLUMNS, min_leaf="min_leaf"),
        f"""passed AS (WITH RECURSIVE step AS (
            SELECT r.row_key, n.fold, n.min_leaf, n.tree, n.node FROM grid_rows r JOIN nodes n ON n.fold = r.own AND n.node = 1
            UNION ALL
            SELECT w.row_key, w.fold, w.min_leaf, w.tree,
                   CASE WHEN CASE n.feature {' '.join(f"WHEN '{c}' THEN r.{c}" for c in COLUMNS)} END < n.threshold THEN n."left" ELSE n."right" END
            FROM step w JOIN grid_rows r USING (row_key) JOIN nodes n USING (fold, min_leaf, tree, node) WHERE n.feature IS NOT NULL)
          SELECT w.*, CAST(floor(n.value * 1e6 + 0.5) AS BIGINT) AS micro FROM step w JOIN nodes n USING (fold, min_leaf, tree, node))""",
        f"""at_depth AS (SELECT row_key, fold, min_leaf, tree, depth, arg_max(micro, node) AS micro
          FROM passed, {_values(GRID['depth'])} d(depth) WHERE node < pow(2, depth + 1) GROUP BY ALL)""",
        f"""scored AS (SELECT row_key, y, {by}, floor(CAST(sum(micro) AS DOUBLE) / trees) AS score
          FROM at_depth JOIN {_values(GRID['trees'])} t(trees) ON tree < trees JOIN grid_rows USING (row_key) GROUP BY row_key, y, {by})""",
        f"""counted AS (SELECT {by}, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL)""",
        f"""ranked AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS below FROM counted)""",
        f"""per_fold AS (SELECT {by}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
          sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM ranked GROUP BY ALL)"""]


def _sql(select: str) -> str:
    return cte(["profiles"], search_sql()) + select


@register("fold_membership", lambda: cte(["profiles"]) + f"SELECT user_id, {FOLD_SQL} AS fold FROM profiles")
def fold_membership(spark: SparkSession, sf: str) -> DataFrame:
    """M4: the fold of every user."""
    return T.profiles(spark, sf).select("user_id", G.fold_of("user_id", FOLDS).alias("fold"))


@register("grid_folds", lambda: _sql(f"SELECT trees, depth, min_leaf, fold, n_pos, n_neg, {Q.fix6('auc')} AS auc FROM per_fold"))
def grid_folds(spark: SparkSession, sf: str) -> DataFrame:
    """M4 + A9: the held-out AUC of every (combination, fold); all forests grown at once, all rows scored at once."""
    per_fold = G.search(grid_rows(spark, sf), "row_key", COLUMNS, "y", GRID, FOLDS)
    return per_fold.select(*G.PARAMETERS, "fold", "n_pos", "n_neg", G.fix6("auc").alias("auc"))


@register("grid_choice", lambda: _sql(f"""
SELECT *, place = 1 AS chosen FROM (
  SELECT *, row_number() OVER (ORDER BY mean_auc DESC NULLS LAST, trees, depth, min_leaf DESC) AS place
  FROM (SELECT trees, depth, min_leaf, count(auc) AS folds, {Q.fix6('avg(auc)')} AS mean_auc FROM per_fold GROUP BY ALL) m) p"""))
def grid_choice(spark: SparkSession, sf: str) -> DataFrame:
    """M4 + M8: combinations by their mean AUC over the folds, and the choice."""
    return G.choose(G.search(grid_rows(spark, sf), "row_key", COLUMNS, "y", GRID, FOLDS))
