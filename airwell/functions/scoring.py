"""Exposure indexes, personal risk and recommendation texts as Column builders.

All rules are plain Spark expressions, so they stay inside whole-stage codegen
and are shared by batch and streaming plans.  Arithmetic follows the original
order of operations so that doubles agree to the last bit.

NULL rules: a missing reading makes every index that uses it NULL; a missing
profile makes the personal score NULL; advice built from a NULL value is
absent (NULL) and dropped from the recommendation list.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from airwell import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x: float) -> Column:
    return F.lit(float(x))


@dataclass(frozen=True)
class Weights:
    pollen: dict = field(default_factory=lambda: dict(K.POLLEN_WEIGHTS))
    risk: dict = field(default_factory=lambda: dict(K.RISK_WEIGHTS))
    allergy_factor: float = K.ALLERGY_FACTOR
    conditions: tuple = tuple(K.CONDITION_FACTORS)


DEFAULT_WEIGHTS = Weights()


def clamp01_guarded(x: Column) -> Column:
    """min(max(x, 0), 1) that keeps NULL (Spark's least/greatest skip NULLs and
    rank NaN above all numbers; NaN counts as missing)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, _lit(0.0)), _lit(1.0)))


def nan_to_null(x) -> Column:
    return F.nanvl(_c(x), F.lit(None).cast("double"))


# R1 ---------------------------------------------------------------------------
def pollen_score(pollen: str, w: Weights = DEFAULT_WEIGHTS) -> Column:
    return F.col(pollen) * _lit(w.pollen[pollen])


def pei(w: Weights = DEFAULT_WEIGHTS) -> Column:
    total = None
    for p in K.POLLENS:
        s = pollen_score(p, w)
        total = s if total is None else total + s
    return total


def pollen_scores_map(w: Weights = DEFAULT_WEIGHTS) -> Column:
    args = []
    for p in K.POLLENS:
        args += [F.lit(p), pollen_score(p, w)]
    return F.create_map(*args)


# R2 ---------------------------------------------------------------------------
def aqii() -> Column:
    total = F.col("european_aqi")
    for col, cap, mult in K.AQII_TERMS:
        total = total + (F.col(col) / _lit(cap)) * _lit(mult)
    return total


# R3 ---------------------------------------------------------------------------
def air_impact(w: Weights = DEFAULT_WEIGHTS) -> Column:
    r = w.risk
    return ((F.col("european_aqi") / _lit(100.0)) * _lit(r["aqi"])
            + (F.col("pm10") / _lit(100.0)) * _lit(r["pm10"])
            + (F.col("pm2_5") / _lit(100.0)) * _lit(r["pm2_5"])
            + (F.col("ozone") / _lit(100.0)) * _lit(r["ozone"]))


# R4 ---------------------------------------------------------------------------
def opii(pei_col: Column | None = None, w: Weights = DEFAULT_WEIGHTS) -> Column:
    p = pei(w) if pei_col is None else pei_col
    return p * (F.col("ozone") / _lit(K.OZONE_REFERENCE))


# R5 ---------------------------------------------------------------------------
def pmhi() -> Column:
    a, b = K.PMHI_WEIGHTS
    return F.col("pm10") * _lit(a) + F.col("pm2_5") * _lit(b)


# R6 ---------------------------------------------------------------------------
def ceri(pei_col=None, aqii_col=None, opii_col=None, pmhi_col=None, w: Weights = DEFAULT_WEIGHTS) -> Column:
    p = pei(w) if pei_col is None else _c(pei_col)
    a = aqii() if aqii_col is None else _c(aqii_col)
    o = opii(p, w) if opii_col is None else _c(opii_col)
    m = pmhi() if pmhi_col is None else _c(pmhi_col)
    return clamp01_guarded((p + a + o + m) / _lit(K.CERI_DIVISOR))


# R7 ---------------------------------------------------------------------------
def _flag_factor(flag: str, factor: float) -> Column:
    """factor when flag is true, 1.0 when false or not set.  x * 1.0 == x
    exactly, so this equals the if/else of the rule."""
    return F.when(F.col(flag), _lit(factor)).otherwise(_lit(1.0))


def risk_score(w: Weights = DEFAULT_WEIGHTS) -> Column:
    base = None
    wp = _lit(w.risk["pollen"])
    for p in K.POLLENS:
        term = (pollen_score(p, w) * wp) * _flag_factor(f"{p}_allergy", w.allergy_factor)
        base = term if base is None else base + term
    x = base + air_impact(w)
    for flag, factor in w.conditions:
        x = x * _flag_factor(flag, factor)
    x = x / _lit(K.RISK_DIVISOR)
    # without a profile there is no personal score
    flags = [F.col(f"{p}_allergy") for p in K.POLLENS] + [F.col(f) for f, _ in w.conditions]
    known = F.coalesce(*flags).isNotNull()
    return F.when(known & x.isNotNull() & ~F.isnan(x), F.least(x, _lit(1.0)))


# R8 ---------------------------------------------------------------------------
def advice_general(score) -> Column:
    s = _c(score)
    lo, hi = K.GENERAL_CUTS
    return (F.when(s.isNull() | F.isnan(s), F.lit(None).cast("string"))
            .when(s < lo, F.lit(K.GENERAL_MILD))
            .when(s < hi, F.lit(K.GENERAL_MODERATE))
            .otherwise(F.lit(K.GENERAL_SEVERE)))


# R9 ---------------------------------------------------------------------------
def pollen_label(name) -> Column:
    """'alder_pollen' -> 'Alder Pollen' (P23)."""
    return F.initcap(F.regexp_replace(_c(name), "_", " "))


def _title(p: str) -> str:
    return p.replace("_", " ").title()


def advice_pollen(pollen: str, w: Weights = DEFAULT_WEIGHTS) -> Column:
    s = pollen_score(pollen, w)
    lo, hi = K.CONDITION_CUTS
    t = _title(pollen)
    txt = (F.when(s.isNull(), F.lit(None).cast("string"))
           .when(s < lo, F.lit(t + K.POLLEN_LOW))
           .when(s < hi, F.lit(t + K.POLLEN_MODERATE))
           .otherwise(F.lit(t + K.POLLEN_HIGH)))
    return F.when(F.col(f"{pollen}_allergy"), txt)


def advice_pollen_all(w: Weights = DEFAULT_WEIGHTS) -> list[Column]:
    return [advice_pollen(p, w) for p in K.POLLENS]


# A11 / R10 --------------------------------------------------------------------
def allergic_count() -> Column:
    n = None
    for p in K.POLLENS:
        t = F.when(F.col(f"{p}_allergy"), F.lit(1)).otherwise(F.lit(0))
        n = t if n is None else n + t
    return n


def allergic_mean(w: Weights = DEFAULT_WEIGHTS) -> Column:
    """Mean pollen score over the user's allergies; NULL when there are none."""
    total = _lit(0.0)
    for p in K.POLLENS:
        total = total + F.when(F.col(f"{p}_allergy"), pollen_score(p, w)).otherwise(_lit(0.0))
    n = allergic_count()
    return F.when(n > 0, total / n.cast("double"))


def _condition_advice(flag: str, texts: tuple, w: Weights) -> Column:
    m = allergic_mean(w)
    low, mid, high = texts
    lo, hi = K.CONDITION_CUTS
    # No allergies: the mean is undefined; like the original (NaN compares
    # false everywhere) this falls through to the high-risk text.
    txt = (F.when(allergic_count() == 0, F.lit(high))
           .when(m.isNull(), F.lit(None).cast("string"))
           .when(m < lo, F.lit(low))
           .when(m < hi, F.lit(mid))
           .otherwise(F.lit(high)))
    return F.when(F.col(flag), txt)


def advice_asthma(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return _condition_advice("asthma_allergy", K.ASTHMA_TEXTS, w)


def advice_hay_fever(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return _condition_advice("hay_fever", K.HAY_FEVER_TEXTS, w)


def advice_eczema(w: Weights = DEFAULT_WEIGHTS) -> Column:
    return _condition_advice("eczema", K.ECZEMA_TEXTS, w)


def risk_undefined() -> Column:
    """True where condition advice relies on an undefined mean (no allergies)."""
    return (allergic_count() == 0) & (F.col("asthma_allergy") | F.col("hay_fever") | F.col("eczema"))


# R11 ----------------------------------------------------------------------------
def advice_cardiac() -> Column:
    return F.when(F.col("cad"), F.lit(K.CARDIAC_TEXT))


# R12-R14 ------------------------------------------------------------------------
def advice_heart(hr="avg_heart_rate", act="avg_activity_level") -> Column:
    h, a = _c(hr), _c(act)
    return (F.when((h > _lit(K.HEART_HIGH)) & (a < _lit(K.HEART_HIGH_ACTIVITY)), F.lit(K.HEART_HIGH_TEXT))
            .when(h < _lit(K.HEART_LOW), F.lit(K.HEART_LOW_TEXT)))


def advice_skin(skin="avg_skin_temp") -> Column:
    return F.when(_c(skin) > _lit(K.SKIN_HIGH), F.lit(K.SKIN_TEXT))


def advice_activity(hr="avg_heart_rate", eda="avg_eda", act="avg_activity_level") -> Column:
    h, e, a = _c(hr), _c(eda), _c(act)
    return (F.when((h > _lit(K.ACTIVE_HR)) & (e > _lit(K.ACTIVE_EDA)) & (a > _lit(K.ACTIVE_LEVEL)),
                   F.lit(K.ACTIVITY_TEXT))
            .when((h > _lit(K.STRESS_HR)) & (e > _lit(K.STRESS_EDA)) & (a < _lit(K.STRESS_LEVEL)),
                  F.lit(K.STRESS_TEXT)))


# R15 ----------------------------------------------------------------------------
def advice_parts(score="final_score", w: Weights = DEFAULT_WEIGHTS) -> list[Column]:
    return ([advice_general(score)] + advice_pollen_all(w)
            + [advice_asthma(w), advice_hay_fever(w), advice_eczema(w), advice_cardiac(),
               advice_heart(), advice_skin(), advice_activity()])


def recommendations(score="final_score", w: Weights = DEFAULT_WEIGHTS) -> Column:
    return F.array_compact(F.array(*advice_parts(score, w)))


# R16 ----------------------------------------------------------------------------
def score_columns(w: Weights = DEFAULT_WEIGHTS) -> dict[str, Column]:
    """Index columns in dependency order; use with successive withColumns."""
    return {
        "pei": pei(w),
        "aqii": aqii(),
        "pmhi": pmhi(),
        "final_score": risk_score(w),
    }


def with_scores(df, w: Weights = DEFAULT_WEIGHTS, with_list: bool = True):
    """Add every index, the personal score and (optionally) the advice list."""
    out = df.withColumns(score_columns(w))
    out = out.withColumn("opii", opii(F.col("pei"), w))
    out = out.withColumn("ceri", ceri("pei", "aqii", "opii", "pmhi", w))
    if with_list:
        out = out.withColumn("recommendations", recommendations("final_score", w))
    return out


def fix6(x) -> Column:
    """Round half up at 6 decimals as floor(x*1e6+0.5)/1e6, an IEEE-exact
    recipe that other engines can repeat bit for bit (Spark's ``round`` breaks
    decimal ties on the exact binary value instead)."""
    c = _c(x)
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)
