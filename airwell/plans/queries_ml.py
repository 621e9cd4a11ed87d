"""Classifier queries (M3, M5, M6, M9).  Tree learners of two engines differ, so
these are compared by rows and quality bands, not by values: no oracle SQL.
The forecast (M10, M11) is in ``queries_forest``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airwell.operators import filters as FL
from airwell.operators import ml as ML
from airwell.plans.catalog import register
from airwell.sources import tables as T

CLASSIFIER_COLS = ["age", "bmi", "gender", "current_smoker", "family_history_asthma", "eczema", "hay_fever"]


def _profile_features(spark: SparkSession, sf: str) -> DataFrame:
    p = T.profiles(spark, sf)
    return p.select("user_id", *[F.col(c).cast("double").alias(c) for c in CLASSIFIER_COLS],
                    F.col("asthma_allergy").cast("double").alias("label"))


@register("rf_score")
def rf_score(spark: SparkSession, sf: str) -> DataFrame:
    """M3 + M9: forest of 100 trees on an 80/20 split by user hash; scores
    of the held-out users."""
    train, test = FL.hash_split(_profile_features(spark, sf), "user_id", [0.8, 0.2])
    model = ML.train_classifier(train, CLASSIFIER_COLS, "label", "rf", num_trees=100, max_depth=10)
    return ML.score(model, test, ["user_id", "label"])


@register("gbt_score")
def gbt_score(spark: SparkSession, sf: str) -> DataFrame:
    """M5 + M6 + M9: boosted trees (100 rounds, depth 6) with balanced class
    weights; scores of the held-out users."""
    data = ML.balanced_weights(_profile_features(spark, sf), "label")
    train, test = FL.hash_split(data, "user_id", [0.8, 0.2])
    model = ML.train_classifier(train, CLASSIFIER_COLS, "label", "gbt", num_trees=100, max_depth=6,
                                weight_col="weight")
    return ML.score(model, test, ["user_id", "label"])
