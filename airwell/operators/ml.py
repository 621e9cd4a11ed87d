"""Machine learning on tables with Spark MLlib.

Training and scoring are MLlib jobs over DataFrames.  The per-(valley,
pollen) forests of the forecast are many small independent fits: their
features are computed once and persisted, and the fits run concurrently from
a bounded thread pool (each fit is its own distributed job).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, PolynomialExpansion, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TREE_DEPTH = 30  # MLlib's limit; the original grows trees without a limit
TASK_ROWS = 50_000   # rows that one task of a fit holds: MLlib keeps a weight per row and tree


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """M1: alphabetical codes 0..k-1 (StringIndexer, alphabetAsc)."""
    m = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    return m.transform(df)


def poly2(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """M7: degree-2 expansion; MLlib's order is x, x^2, y, xy, y^2."""
    v = VectorAssembler(inputCols=cols, outputCol="_v").transform(df.select(key, *[F.col(c).cast("double") for c in cols]))
    p = PolynomialExpansion(degree=2, inputCol="_v", outputCol="_p").transform(v)
    n = len(cols) * (len(cols) + 3) // 2
    arr = vector_to_array("_p")
    return p.select(key, *[arr[i].alias(f"poly_{i}") for i in range(n)])


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """M5: weight = n / (2 * n_class) from class counts (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = counts.agg(F.sum("_nc")).first()[0]
    counts = counts.withColumn("weight", F.lit(float(total)) / (F.lit(2.0) * F.col("_nc")))
    return df.join(F.broadcast(counts.select(label, "weight")), label, "left")


def features_pipeline(cols: list[str], out: str = "features") -> list:
    """M2: mean imputation then assembly."""
    imp = [f"{c}__imp" for c in cols]
    return [Imputer(inputCols=cols, outputCols=imp, strategy="mean"),
            VectorAssembler(inputCols=imp, outputCol=out)]


def spread(df: DataFrame) -> DataFrame:
    """``df`` in partitions of about ``TASK_ROWS`` rows.  A small file of many short rows is one task; bags are drawn
    per partition, so rows are cut by their own hash and sorted, and the same rows give the same model.  A table
    that fits one task stays as it is."""
    n = df.count()
    if n <= TASK_ROWS:
        return df
    return df.repartition(-(-n // TASK_ROWS), *df.columns).sortWithinPartitions(*df.columns)


def train_classifier(train: DataFrame, cols: list[str], label: str, kind: str = "rf", seed: int = 42,
                     num_trees: int = 100, max_depth: int = 10, weight_col: str | None = None) -> PipelineModel:
    """M3 / M5 / M6: forest or boosted trees on imputed, assembled features."""
    if kind == "rf":
        est = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees,
                                     maxDepth=max_depth, seed=seed)
    else:
        est = GBTClassifier(labelCol=label, featuresCol="features", maxIter=num_trees, maxDepth=max_depth, seed=seed)
    if weight_col:
        est = est.setWeightCol(weight_col)
    return Pipeline(stages=features_pipeline(cols) + [est]).fit(spread(train))


def tune_forest(train: DataFrame, cols: list[str], label: str, grid: dict | None = None, folds: int = 5,
                parallelism: int = 4, seed: int = 42) -> PipelineModel:
    """M4: grid search with k-fold cross-validation on ROC-AUC."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed)
    grid = grid or {"numTrees": [100, 200, 300], "maxDepth": [5, 10, 20, 30],
                    "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "all"]}
    b = ParamGridBuilder()
    for k, vals in grid.items():
        b = b.addGrid(rf.getParam(k), vals)
    cv = CrossValidator(estimator=Pipeline(stages=features_pipeline(cols) + [rf]), estimatorParamMaps=b.build(),
                        evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds,
                        parallelism=parallelism, seed=seed)
    return cv.fit(train).bestModel


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """M9: probability of the positive class and the > 0.5 flag."""
    out = model.transform(spread(df.select(*dict.fromkeys([*keep, *model.stages[0].getInputCols()]))))
    p1 = vector_to_array("probability")[1]
    return out.select(*keep, p1.alias("probability"), (p1 > 0.5).alias("prediction"))


# ------------------------------------------------------------------ M10 / M11 / K10
def train_forests(features: DataFrame, groups: list[tuple], group_cols: list[str], label_of, feature_cols_of,
                  path: str, num_trees: int = 100, max_depth: int = MAX_TREE_DEPTH, seed: int = 42,
                  threads: int = 8) -> list[tuple]:
    """One regression forest per group, saved to
    ``path/<col>=<value>/...`` (K10).  Returns (group..., model_path, n_rows,
    model); the model is None for groups with fewer than two rows."""
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    features.count()   # fill the cache once, before the fits start in parallel

    def fit(g):
        cond = F.lit(True)
        for c, v in zip(group_cols, g):
            cond = cond & (F.col(c) == F.lit(v))
        label, cols = label_of(g), feature_cols_of(g)
        data = features.where(cond).select(*cols, label).na.drop()
        n = data.count()
        if n < 2:
            return (*g, None, n, None)
        va = VectorAssembler(inputCols=cols, outputCol="features")
        rf = RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=num_trees,
                                   maxDepth=max_depth, seed=seed)
        model = rf.fit(va.transform(data))
        where = "/".join(f"{c}={v}" for c, v in zip(group_cols, g))
        mpath = f"{path}/{where}"
        model.write().overwrite().save(mpath)
        return (*g, mpath, n, model)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        out = list(pool.map(fit, groups))
    features.unpersist()
    return out


def load_forest(path: str) -> RandomForestRegressionModel:
    return RandomForestRegressionModel.load(path)
