"""Pollen risk classes and colours (R17-R19) as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwell import constants as K
from airwell.functions.scoring import nan_to_null


def concentration_or_zero(x) -> Column:
    """Absent or NaN concentrations count as 0.0 (text is parsed leniently)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(nan_to_null(c.try_cast("double")), F.lit(0.0))


def pollen_class(pollen_type, concentration) -> Column:
    """Inclusive upper bounds per pollen type; unknown type -> label."""
    t = F.col(pollen_type) if isinstance(pollen_type, str) else pollen_type
    x = concentration_or_zero(concentration)
    expr = None
    for name, (b1, b2, b3) in K.POLLEN_CLASS_BOUNDS.items():
        level = (F.when(x <= F.lit(b1), F.lit(K.POLLEN_LEVELS[0]))
                 .when(x <= F.lit(b2), F.lit(K.POLLEN_LEVELS[1]))
                 .when(x <= F.lit(b3), F.lit(K.POLLEN_LEVELS[2]))
                 .otherwise(F.lit(K.POLLEN_LEVELS[3])))
        expr = (F.when(t == F.lit(name), level) if expr is None
                else expr.when(t == F.lit(name), level))
    return expr.otherwise(F.lit(K.UNKNOWN_POLLEN_LABEL))


def class_colour(level) -> Column:
    """Level -> colour, grey for anything else."""
    lv = F.col(level) if isinstance(level, str) else level
    m = F.create_map(*[a for k, v in K.LEVEL_COLOURS.items() for a in (F.lit(k), F.lit(v))])
    return F.coalesce(m[lv], F.lit(K.UNKNOWN_COLOUR))


def risk_table(latest: DataFrame, key: str = "municipality_id") -> DataFrame:
    """Wide latest readings -> long (site, pollen, level, colour)."""
    names = list(K.POLLEN_CLASS_BOUNDS)
    pairs = ", ".join(f"'{n}', `{n.lower()}_pollen`" for n in names)
    long = latest.selectExpr(key, f"stack({len(names)}, {pairs}) AS (pollen, concentration)")
    level = pollen_class("pollen", "concentration")
    return (long.withColumn("level", level)
                .withColumn("colour", class_colour("level"))
                .withColumn("concentration", concentration_or_zero("concentration")))
