"""Cohort enrichment (C1-C5) as one distributed, repeatable projection.

Every random draw is a pure function of (row key, salt): the first eight hex
digits of MD5(key || ':' || salt) scaled to [0, 1).  A draw does not depend
on partitioning, task retries or file order, so a lost executor recomputes
the same flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwell import constants as K


def uniform(key, salt: str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    h = F.substring(F.md5(F.concat(k.cast("string"), F.lit(":" + salt))), 1, 8)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def assign_allergies(df: DataFrame, key: str, family_history: str = "family_history_asthma",
                     rates=None, p_eczema: float = K.PROB_ECZEMA, p_asthma_hist: float = K.PROB_ASTHMA_WITH_HISTORY,
                     p_asthma: float = K.PROB_ASTHMA, p_gate: float = K.PROB_POLLEN_GATE) -> DataFrame:
    """Eczema, asthma (higher with family history) and the six pollen
    allergies; when eczema or asthma holds, pollen draws pass a gate first."""
    rates = rates or K.POLLEN_BASE_RATES
    eczema = uniform(key, "eczema") < F.lit(p_eczema)
    p_a = F.when(F.col(family_history), F.lit(p_asthma_hist)).otherwise(F.lit(p_asthma))
    asthma = uniform(key, "asthma") < p_a
    out = df.withColumns({"eczema": eczema, "asthma_allergy": asthma})
    prone = F.col("eczema") | F.col("asthma_allergy")
    gate = uniform(key, "gate") < F.lit(p_gate)
    flags = {}
    for name, p in rates:
        draw = uniform(key, name) < F.lit(p)
        flags[name] = F.when(prone, gate & draw).otherwise(draw)
    return out.withColumns(flags)


def repair_hay_fever(df: DataFrame, key: str, hay_fever: str = "hay_fever", names=None) -> DataFrame:
    """A hay-fever case with no pollen allergy gets one, picked uniformly."""
    names = names or K.HAY_FEVER_PICK_ORDER
    none = ~F.greatest(*[F.col(n) for n in names])
    pick_idx = F.floor(uniform(key, "pick") * F.lit(len(names))).cast("int")
    need = F.col(hay_fever) & none
    return df.withColumns({n: F.col(n) | (need & (pick_idx == F.lit(i))) for i, n in enumerate(names)})


def birth_date(key, age, reference_year: int) -> Column:
    """year = reference_year - age; month and day drawn uniformly, the
    day within the month's length (leap years included)."""
    y = F.lit(reference_year) - (F.col(age) if isinstance(age, str) else age)
    m = (F.floor(uniform(key, "month") * F.lit(12)) + 1).cast("int")
    first = F.make_date(y.cast("int"), m, F.lit(1))
    ndays = F.dayofmonth(F.last_day(first))
    d = (F.floor(uniform(key, "day") * ndays) + 1).cast("int")
    return F.make_date(y.cast("int"), m, d)


def clamp_code(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp to [lo, hi] and round to an integer code (half to even)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.bround(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)), 0).cast("int"))


def cohort(df: DataFrame, key: str, reference_year: int, drop: list[str] = (), round_cols: list[str] = ()) -> DataFrame:
    """C4: allergies, hay-fever repair, birth date, drops and 1-decimal rounding
    in one projection chain."""
    from airwell.functions.prepare import round_half_even
    out = repair_hay_fever(assign_allergies(df, key), key)
    out = out.withColumn("date_of_birth", birth_date(key, "age", reference_year))
    out = out.withColumns({c: round_half_even(c, 1) for c in round_cols})
    return out.drop("age", *drop)
