"""Statistics and evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airwell.session import materialize


def class_share(df: DataFrame, col: str) -> DataFrame:
    """A5: (value, n, share).  The total is a scalar subquery, so the classes
    stay distributed however many there are."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """Mean of each boolean flag, one pass."""
    return df.agg(*[F.avg(F.col(f).cast("int")).alias(f) for f in flags])


def impute_mean(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """NULL -> column mean.  The means are one aggregated row (k numbers
    on the driver), applied as literals."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    return df.withColumns({c + suffix: F.coalesce(F.col(c), F.lit(means[c]).cast("double")) for c in cols})


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """N, RMSE, MAE and R^2 (1 - SSE/SST) per group, in one aggregation
    (SST = population variance times n, which does not cancel at large n)."""
    e = F.col(y) - F.col(yhat)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            F.sum(e * e).alias("_sse"),
            (F.var_pop(F.col(y)) * F.count(F.lit(1))).alias("_sst")]
    g = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    g = g.groupBy(*(by or [])).agg(*aggs) if by else g.agg(*aggs)
    sst = F.col("_sst")
    return g.withColumn("r2", F.when(sst > 0, F.lit(1.0) - F.col("_sse") / sst)).drop("_sse", "_sst")


def class_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall from confusion counts."""
    yv, pv = F.col(y).cast("int"), F.col(yhat).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(F.when((yv == 1) & (pv == 1), 1).otherwise(0)).alias("tp"),
            F.sum(F.when((yv == 0) & (pv == 1), 1).otherwise(0)).alias("fp"),
            F.sum(F.when((yv == 1) & (pv == 0), 1).otherwise(0)).alias("fn"),
            F.sum(F.when((yv == 0) & (pv == 0), 1).otherwise(0)).alias("tn")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return (g.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
             .withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
             .withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))))


def auc_exact(df: DataFrame, y: str, score: str, by: str | None = None, buckets: int = 256) -> DataFrame:
    """Exact ROC-AUC (ties count one half), i.e. Mann-Whitney U.

    Per group and distinct score, positives and negatives are counted.  The
    number of negatives below each score is a distributed prefix sum: scores
    are cut into ``buckets`` ranges at approximate quantiles (a few hundred
    numbers on the driver); bucket totals are summed in bucket order (one row
    per bucket), and only the rows of one bucket are ordered together.
    """
    keys = [by] if by else []
    yv = F.col(y).cast("int")
    s = (df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
           .groupBy(*keys, score)
           .agg(F.sum(yv).alias("pos"), F.sum(F.lit(1) - yv).alias("neg")))
    s = materialize(s, "auc-scores")    # read by the quantiles, the bucket totals and the order
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(x for x in s.approxQuantile(score, probs, 0.001) if x is not None))
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    s = s.withColumn("_bk", F.size(F.filter(edges, lambda e: e < F.col(score).cast("double"))))
    per_b = s.groupBy(*keys, "_bk").agg(F.sum("neg").alias("_bneg"))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.withColumn("_before", F.coalesce(F.sum("_bneg").over(wb), F.lit(0))).drop("_bneg")
    s = s.join(per_b, keys + ["_bk"])
    wi = Window.partitionBy(*keys, "_bk").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("neg_below", F.col("_before") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
    contrib = F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))
    agg = [F.sum(contrib).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    g = s.groupBy(*keys).agg(*agg) if keys else s.agg(*agg)
    return g.withColumn("auc", F.try_divide(F.col("_u"), (F.col("n_pos") * F.col("n_neg")).cast("double"))).drop("_u")


def pivot_metrics(long: DataFrame, row: str, col: str, values: list[str], metrics: list[str]) -> DataFrame:
    """A10: long (row, col, metric...) -> wide, one column per (col value, metric)."""
    aggs = [F.first(m, ignorenulls=True).alias(m) for m in metrics]
    return long.groupBy(row).pivot(col, values).agg(*aggs)


def best_by(df: DataFrame, name: str, metric: str, by: list[str] | None = None) -> DataFrame:
    """Arg-max of a metric (ties: greatest name)."""
    best = F.max_by(F.col(name), F.struct(F.col(metric), F.col(name))).alias(f"best_{name}")
    top = F.max(metric).alias(metric)
    return df.groupBy(*by).agg(best, top) if by else df.agg(best, top)
