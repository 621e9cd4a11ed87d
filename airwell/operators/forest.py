"""Regression forests of many groups, grown at once (M10), kept as rows
and applied by joins (M9, J10).

Rows become bins first, and those of a group with the same bins one weighted
row per tree (a cell).  All trees of all groups grow level by level over the
cells.  A level is one aggregation to (group, tree, node, feature, bin ->
weight, sum), combined on the map side; the best split of every node follows
from running sums over its bins, and a join on (group, tree, node) sends the
cells on to the children.  The number of jobs
follows from the depth, not from the number of groups, and no group is a task
of its own: a group that holds a third of all rows is reduced to its bins
before anything is shuffled.

Targets are summed as whole millionths, so sums do not depend on their order
and the same rows give the same trees wherever they lie.  Bags are drawn by a
hash of the row's key and the tree's number.

A model is a table of nodes: (group..., tree, node, feature, threshold, left,
right, n, value).  Node 1 is the root, 2 i and 2 i + 1 are below i; leaves have
no feature.  A row goes left where its feature is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airwell.session import _fs, list_names, materialize

MICRO = 1_000_000
# Poisson(1): a draw below the k-th value gives weight k, above all the next one
BAG_LIMITS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)


def bag_draw(key: Column, tree: Column) -> Column:
    """A row's draw in [0, 1) for a tree."""
    text = F.concat(key.cast("string"), F.lit(":bag"), tree.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bag_weight(draw: Column) -> Column:
    """How often a row of this draw is in the tree's bag."""
    out = F.lit(0)
    for k, limit in enumerate(BAG_LIMITS, 1):
        out = F.when(draw >= F.lit(limit), k).otherwise(out)
    return out.cast("long")


def _edge(low: Column, high: Column, share: Column) -> Column:
    return low + (high - low) * share


def ranges_of(rows: DataFrame, groups: list[str], features: list[str]) -> DataFrame:
    """Each group's range per feature, ``_lo``/``_hi`` arrays: a table of its own, so its size decides how it is joined."""
    return materialize(rows.groupBy(*groups).agg(F.array(*[F.min(c).cast("double") for c in features]).alias("_lo"),
                                                 F.array(*[F.max(c).cast("double") for c in features]).alias("_hi")), "forest-ranges")


def binned(rows: DataFrame, ranges: DataFrame, groups: list[str], features: list[str], bins: int) -> DataFrame:
    """``rows`` with ``_bins``: how many of the ``bins`` - 1 inner edges of its group's range a value has reached.
    The edges are worked out once per group; spelt out per row they make a method too long to be compiled."""
    edges = ranges.select(*groups, F.array(*[F.array(*[_edge(F.col("_lo")[i], F.col("_hi")[i], F.lit(k / bins)) for k in range(1, bins)])
                                             for i in range(len(features))]).alias("_edges"))

    def place(i: int, c: str) -> Column:
        return F.size(F.filter(F.col("_edges")[i], lambda e: F.col(c).cast("double") >= e))
    return rows.join(edges, groups).withColumn("_bins", F.array(*[place(i, c) for i, c in enumerate(features)])).drop("_edges")


def cells_of(rows: DataFrame, groups: list[str], features: list[str], target: str, key: Column, trees: int = 1, bins: int = 8,
             bootstrap: bool = True) -> tuple[DataFrame, DataFrame]:
    """((group..., tree, _bins, _w, _wy), ranges): what the trees of each group grow from.

    Rows of a group with the same bins go the same way in every tree, so they
    are added up before anything is shuffled: the table has a row per
    combination of bins that occurs, not one per row and tree."""
    needed = [*groups, *features, target]
    t = rows.select(*needed, key.alias("_key")).na.drop(subset=needed)
    ranges = ranges_of(t, groups, features)
    tree = F.sequence(F.lit(0), F.lit(trees - 1))
    # the draws are a generator's rows: each is worked out once, however often its weight is asked for
    draw = F.explode(F.transform(tree, lambda i: F.struct(i.alias("tree"), bag_draw(F.col("_key"), i).alias("u")))).alias("_d")
    w = bag_weight(F.col("_d.u")) if bootstrap else F.lit(1).cast("long")
    micro = F.floor(F.col(target) * F.lit(float(MICRO)) + F.lit(0.5)).cast("long")
    t = binned(t, ranges, groups, features, bins).select(*groups, "_bins", micro.alias("_y"), draw)
    t = t.select(*groups, F.col("_d.tree").alias("tree"), "_bins", w.alias("_w"), "_y").where(F.col("_w") > 0)
    cells = t.groupBy(*groups, "tree", "_bins").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_y")).alias("_wy"))
    return materialize(cells, "forest-cells"), ranges


def grow(rows: DataFrame, groups: list[str], features: list[str], target: str, key: Column, trees: int = 1,
         depth: int = 3, bins: int = 8, min_leaf: int | str = 1, bootstrap: bool = True) -> DataFrame:
    """The node table of one forest per group.  ``min_leaf`` is a number or the
    group column that holds each group's own.

    Rows with a null among groups, features and target take no part; an empty
    table gives no nodes; a group of one row is one leaf."""
    cells, ranges = cells_of(rows, groups, features, target, key, trees, bins, bootstrap)
    return grow_cells(cells, ranges, groups, features, depth, bins, min_leaf)


def grow_cells(cells: DataFrame, ranges: DataFrame, groups: list[str], features: list[str], depth: int = 3, bins: int = 8,
               min_leaf: int | str = 1) -> DataFrame:
    """``grow`` from its cells; the groups may have more columns than those that ``ranges`` is by."""
    at = [*groups, "tree", "node"]
    t = cells.withColumn("node", F.lit(1).cast("long"))
    levels = [t.groupBy(*at).agg(F.sum("_w").alias("n"), F.sum("_wy").alias("s"))]
    splits = []
    for level in range(depth):
        best = materialize(_best_splits(t, ranges, at, len(features), bins, min_leaf), "forest-splits")
        if best.isEmpty():
            break
        splits.append(best)
        child = F.explode(F.array(*[F.struct((F.col("node") * 2 + side).alias("node"), F.col(f"n{side}").alias("n"), F.col(f"s{side}").alias("s"))
                                    for side in (0, 1)])).alias("c")
        levels.append(best.select(*groups, "tree", child).select(*groups, "tree", "c.node", "c.n", "c.s"))
        if level + 1 < depth:
            go = best.select(*at, "feature", "bin")
            right = (F.element_at("_bins", F.col("feature") + 1) > F.col("bin")).cast("long")
            t = materialize(t.join(go, at).withColumn("node", F.col("node") * 2 + right).drop("feature", "bin"), "forest-rows")
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    named = None
    for best in splits:
        named = best if named is None else named.unionByName(best)
    value = (F.col("s").cast("double") / F.col("n").cast("double")) / F.lit(float(MICRO))
    if named is None:
        return nodes.select(*at, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"),
                            F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "n", value.alias("value"))
    names = F.array(*[F.lit(c) for c in features])
    told = named.select(*at, F.element_at(names, F.col("feature") + 1).alias("feature"), "threshold")
    return nodes.join(told, at, "left").select(
        *at, "feature", "threshold", F.when(F.col("feature").isNotNull(), F.col("node") * 2).alias("left"),
        F.when(F.col("feature").isNotNull(), F.col("node") * 2 + 1).alias("right"), "n", value.alias("value"))


def _best_splits(t: DataFrame, ranges: DataFrame, at: list[str], n_features: int, bins: int, min_leaf: int | str) -> DataFrame:
    """(at..., feature, bin, threshold, n0, s0, n1, s1): the split of each node with the largest gain in squared sums;
    equal gains go to the first feature and bin."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col("_bins")[i].alias("bin")) for i in range(n_features)])).alias("f")
    hist = t.select(*at, "_w", "_wy", each).groupBy(*at, "f.feature", "f.bin").agg(
        F.sum("_w").alias("n"), F.sum("_wy").alias("s"))
    least = F.col(min_leaf) if isinstance(min_leaf, str) else F.lit(min_leaf)
    whole = Window.partitionBy(*at, "feature")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cand = hist.select(*at, "feature", "bin", F.sum("n").over(so_far).alias("n0"), F.sum("s").over(so_far).alias("s0"),
                       F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
    cand = cand.withColumn("n1", F.col("n") - F.col("n0")).withColumn("s1", F.col("s") - F.col("s0")) \
        .where((F.col("n0") >= least) & (F.col("n1") >= least) & (F.col("n1") > 0))

    def part(s: str, n: str) -> Column:
        return F.col(s).cast("double") * F.col(s).cast("double") / F.col(n).cast("double")
    cand = cand.withColumn("gain", part("s0", "n0") + part("s1", "n1") - part("s", "n")) \
        .where(F.col("gain") > F.lit(1e-12) * part("s", "n"))
    best = cand.groupBy(*at).agg(F.max_by(F.struct("feature", "bin", "n0", "s0", "n1", "s1"),
                                          F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b")).select(*at, "b.*")
    share = (F.col("bin") + 1).cast("double") / F.lit(float(bins))
    low, high = (F.element_at(c, F.col("feature") + 1) for c in ("_lo", "_hi"))
    return best.join(ranges, [c for c in ranges.columns if c in at]) \
        .select(*at, "feature", "bin", _edge(low, high, share).alias("threshold"), "n0", "s0", "n1", "s1")


# --------------------------------------------------------------- the stored models
def save_models(nodes: DataFrame, path: str, keep: int = 2) -> str:
    """Write a new version of a model table and make it the current one.

    The version's rows are written first; replacing the one small pointer file
    by a rename is the commit, so readers see the old version or the new one,
    whole.  Versions beyond the ``keep`` newest are removed after that."""
    spark = nodes.sparkSession
    known = sorted(n for n in list_names(spark, path) if n.startswith("v="))
    version = f"v={int(known[-1][2:]) + 1 if known else 1:08d}"
    nodes.write.mode("overwrite").parquet(f"{path}/{version}")
    fs, pointer = _fs(spark, f"{path}/CURRENT")
    _, fresh = _fs(spark, f"{path}/CURRENT.next")
    stream = fs.create(fresh, True)
    stream.write(version.encode())
    stream.close()
    fc = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(fresh, pointer, options)
    for old in [n for n in known if n < version][:-(keep - 1) or None]:
        fs.delete(_fs(spark, f"{path}/{old}")[1], True)
    return version


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/CURRENT").first()[0]


def load_models(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The node table of a version, the current one by default."""
    return spark.read.parquet(f"{path}/{version or current_version(spark, path)}")


# --------------------------------------------------------------- scoring
def deepest(nodes: DataFrame) -> int:
    """The number of levels below the roots."""
    last = nodes.agg(F.max("node")).first()[0]
    return last.bit_length() - 1 if last else 0


def predict(rows: DataFrame, nodes: DataFrame, groups: list[str], features: list[str], levels: int | None = None,
            out: str = "prediction") -> DataFrame:
    """``rows`` with the mean of their group's trees; null where the group has no model.

    Rows meet the roots of their group's trees and walk down one level per join
    on (group, tree, node): what is shuffled is a row's features, never a model.
    ``rows`` needs a column ``row_key`` that tells its rows apart."""
    levels = deepest(nodes) if levels is None else levels
    at = [*groups, "tree", "node"]
    node = nodes.select(*at, F.col("feature").alias("_feature"), F.col("threshold").alias("_threshold"), F.col("value").alias("_value"))
    walk = rows.select("row_key", *groups, *features).join(node.where("node = 1"), groups)
    x = F.coalesce(*[F.when(F.col("_feature") == c, F.col(c).cast("double")) for c in features])
    for _ in range(levels):
        below = F.when(F.col("_feature").isNotNull(), F.col("node") * 2 + F.when(x < F.col("_threshold"), 0).otherwise(1))
        step = walk.withColumn("_next", below)
        child = node.select(*groups, "tree", F.col("node").alias("_next"), F.col("_feature").alias("_f"),
                            F.col("_threshold").alias("_t"), F.col("_value").alias("_v"))
        step = step.join(child, [*groups, "tree", "_next"], "left")
        walk = step.select("row_key", *groups, *features, "tree", F.coalesce("_next", "node").alias("node"),
                           F.when(F.col("_next").isNotNull(), F.col("_f")).alias("_feature"),
                           F.when(F.col("_next").isNotNull(), F.col("_t")).alias("_threshold"),
                           F.coalesce("_v", "_value").alias("_value"))
    # whole millionths again: the mean does not depend on the trees' order
    micro = F.floor(F.col("_value") * F.lit(float(MICRO)) + F.lit(0.5)).cast("long")
    mean = walk.groupBy("row_key").agg(((F.sum(micro).cast("double") / F.count("*").cast("double")) / F.lit(float(MICRO))).alias(out))
    return rows.join(mean, "row_key", "left")


def two_steps(rows: DataFrame, nodes: DataFrame, groups: list[str], lags: list[str], others: list[str]) -> DataFrame:
    """W4 with a model: ``rows`` with ``today`` from their lags and ``tomorrow`` from the shifted ones."""
    from airwell.operators.features import shift_lags
    features, levels = [*lags, *others], deepest(nodes)
    first = materialize(predict(rows, nodes, groups, features, levels, "today"), "forecast-today")
    moved = first.withColumns(shift_lags(lags, F.col("today"))).drop("today")
    second = predict(moved, nodes, groups, features, levels, "tomorrow").select("row_key", "tomorrow")
    return first.join(second, "row_key")
