"""Grid search with folds (M4) over the grouped forests.

A row's fold is a draw of its key.  All forests of the search grow at once: a
group is (fold, min_leaf), and a row takes part in every fold but its own.
Numbers of trees and depths need no fits of their own, as a forest of fewer
trees is the first ones of a larger forest and a shallower tree is the top of a
deeper one.  Every row is then scored once by the forests that have not seen
it, which gives one long table (parameters, fold, row, score), and one grouped
AUC over it.  The number of jobs follows from the largest depth, not from the
number of combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airwell.functions.scoring import fix6
from airwell.operators import forest as FO
from airwell.operators.cohort import uniform
from airwell.operators.metrics import auc_exact
from airwell.session import materialize

PARAMETERS = ["trees", "depth", "min_leaf"]


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """The fold (from 0) of a row: a draw of its key, whatever the partitioning."""
    return F.least(F.floor(uniform(key, f"fold{seed}") * F.lit(float(folds))).cast("int"), F.lit(folds - 1))


def _per_leaf_size(df: DataFrame, min_leaf: list[int]) -> DataFrame:
    return df.withColumn("min_leaf", F.explode(F.array(*[F.lit(int(m)) for m in min_leaf])))


def grow_folds(rows: DataFrame, key: str, features: list[str], label: str, folds: int, grid: dict[str, list[int]],
               bins: int = 8) -> DataFrame:
    """The node table of all forests of the search, grouped by (fold, min_leaf);
    a forest has not seen the rows of its own fold."""
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_own"))).alias("fold")
    t = rows.withColumn("_own", fold_of(key, folds)).select(key, *features, label, others)
    cells, ranges = FO.cells_of(t, ["fold"], features, label, F.col(key), max(grid["trees"]), bins)
    return FO.grow_cells(_per_leaf_size(cells, grid["min_leaf"]), ranges, ["fold", "min_leaf"], features, max(grid["depth"]), bins, "min_leaf")


def score_folds(rows: DataFrame, nodes: DataFrame, key: str, features: list[str], label: str, folds: int,
                grid: dict[str, list[int]]) -> DataFrame:
    """(key, label, fold, trees, depth, min_leaf, score): every row by every
    combination, from forests that have not seen it.

    Rows walk down once, to the largest depth, and keep the value of each node
    that they pass.  Scores are whole millionths, so that they do not depend on
    the trees' order.  Rows with a null among features and label take no part."""
    groups = ["fold", "min_leaf"]
    at = [*groups, "tree", "node"]
    micro = F.floor(F.col("value") * F.lit(float(FO.MICRO)) + F.lit(0.5)).cast("long")
    node = nodes.select(*at, F.col("feature").alias("_feature"), F.col("threshold").alias("_threshold"), micro.alias("_micro"))
    held = rows.na.drop(subset=[*features, label]).withColumn("fold", fold_of(key, folds)).select(key, *features, label, "fold")
    walk = _per_leaf_size(held, grid["min_leaf"]).join(node.where("node = 1"), groups).withColumn("_path", F.array("_micro"))
    x = F.coalesce(*[F.when(F.col("_feature") == c, F.col(c).cast("double")) for c in features])
    kept = [key, *features, label, *groups, "tree"]
    for _ in range(max(grid["depth"])):
        below = F.when(F.col("_feature").isNotNull(), F.col("node") * 2 + F.when(x < F.col("_threshold"), 0).otherwise(1))
        child = node.select(*groups, "tree", F.col("node").alias("_next"), F.col("_feature").alias("_f"),
                            F.col("_threshold").alias("_t"), F.col("_micro").alias("_m"))
        step = walk.withColumn("_next", below).join(child, [*groups, "tree", "_next"], "left")
        passed = F.coalesce("_m", "_micro")
        walk = step.select(*kept, F.coalesce("_next", "node").alias("node"), F.when(F.col("_next").isNotNull(), F.col("_f")).alias("_feature"),
                           F.when(F.col("_next").isNotNull(), F.col("_t")).alias("_threshold"), passed.alias("_micro"),
                           F.concat("_path", F.array(passed)).alias("_path"))
    pairs = [(t, d) for t in grid["trees"] for d in grid["depth"]]
    sums = [F.sum(F.when(F.col("tree") < t, F.col("_path")[d])).alias(f"_s{i}") for i, (t, d) in enumerate(pairs)]
    wide = walk.groupBy(key, label, *groups).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("trees"), F.lit(d).alias("depth"), F.floor(F.col(f"_s{i}") / F.lit(t)).alias("score"))
                               for i, (t, d) in enumerate(pairs)])).alias("_e")
    return wide.select(key, label, *groups, each).select(key, label, "fold", "_e.trees", "_e.depth", "min_leaf", "_e.score")


def fold_auc(scored: DataFrame, label: str) -> DataFrame:
    """(trees, depth, min_leaf, fold, n_pos, n_neg, auc): one grouped AUC over
    the long table; the AUC of a fold with one class only is null."""
    names = [*PARAMETERS, "fold"]
    one = scored.withColumn("_model", F.concat_ws(":", *names))
    auc = auc_exact(one.select("_model", label, "score"), label, "score", by="_model")
    part = F.split("_model", ":")
    return auc.select(*[part[i].cast("int").alias(n) for i, n in enumerate(names)], "n_pos", "n_neg", "auc")


def choose(per_fold: DataFrame) -> DataFrame:
    """(trees, depth, min_leaf, folds, mean_auc, place, chosen): combinations
    by their mean AUC, rounded to six decimals; equal ones by fewer trees, less
    depth and larger leaves.  Folds without an AUC are left out of the mean."""
    mean = per_fold.groupBy(*PARAMETERS).agg(F.count("auc").alias("folds"), fix6(F.avg("auc")).alias("mean_auc"))
    # one row per combination: the grid bounds the window
    order = Window.orderBy(F.desc_nulls_last("mean_auc"), "trees", "depth", F.desc("min_leaf"))
    return mean.withColumn("place", F.row_number().over(order)).withColumn("chosen", F.col("place") == 1)


def search(rows: DataFrame, key: str, features: list[str], label: str, grid: dict[str, list[int]], folds: int = 5,
           bins: int = 8) -> DataFrame:
    """The AUC of every (combination, fold).  The rows are spread first: a small
    file of many short rows is one task, and each row is met many times."""
    used = [key, *features, label]
    rows = materialize(rows.select(*used).repartition(*used), "grid-rows")
    nodes = materialize(grow_folds(rows, key, features, label, folds, grid, bins), "grid-nodes")
    return fold_auc(score_folds(rows, nodes, key, features, label, folds, grid), label)


def fit_chosen(rows: DataFrame, key: str, features: list[str], label: str, choice: DataFrame, bins: int = 8) -> DataFrame:
    """The node table of one forest over all rows by the chosen parameters."""
    best = choice.where("chosen").first()
    return FO.grow(rows.withColumn("model", F.lit("chosen")), ["model"], features, label, F.col(key), trees=best["trees"],
                   depth=best["depth"], bins=bins, min_leaf=best["min_leaf"])
