"""SQL fragments for the DuckDB oracle, written from the same formulas as the
Column builders in ``airwell.functions``."""

from __future__ import annotations

from airwell import constants as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    r = K.EARTH_RADIUS_KM
    dphi = f"(radians({lat2} - {lat1}) / 2)"
    dl = f"(radians({lng2} - {lng1}) / 2)"
    h = f"(pow(sin{dphi}, 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin{dl}, 2))"
    return f"({2.0 * r!r} * asin(sqrt(least({h}, 1.0))))"


def pollen_score(p: str) -> str:
    return f"({p} * {K.POLLEN_WEIGHTS[p]!r})"


def pei() -> str:
    return "(" + " + ".join(pollen_score(p) for p in K.POLLENS) + ")"


def aqii() -> str:
    s = "european_aqi"
    for col, cap, mult in K.AQII_TERMS:
        s = f"({s} + ({col} / {cap!r}) * {mult!r})"
    return s


def air_impact() -> str:
    r = K.RISK_WEIGHTS
    return (f"((european_aqi / 100.0e0) * {r['aqi']!r} + (pm10 / 100.0e0) * {r['pm10']!r}"
            f" + (pm2_5 / 100.0e0) * {r['pm2_5']!r} + (ozone / 100.0e0) * {r['ozone']!r})")


def opii(pei_sql: str | None = None) -> str:
    return f"({pei_sql or pei()} * (ozone / {K.OZONE_REFERENCE!r}))"


def pmhi() -> str:
    a, b = K.PMHI_WEIGHTS
    return f"(pm10 * {a!r} + pm2_5 * {b!r})"


def ceri(pei_sql=None, aqii_sql=None, opii_sql=None, pmhi_sql=None) -> str:
    x = f"(({pei_sql or pei()} + {aqii_sql or aqii()} + {opii_sql or opii()} + {pmhi_sql or pmhi()}) / {K.CERI_DIVISOR!r})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, 0.0), 1.0) END)"


def _factor(flag: str, factor: float) -> str:
    return f"(CASE WHEN {flag} THEN {factor!r} WHEN NOT {flag} THEN 1.0e0 END)"


def risk_score() -> str:
    wp = K.RISK_WEIGHTS["pollen"]
    base = None
    for p in K.POLLENS:
        t = f"(({pollen_score(p)} * {wp!r}) * {_factor(f'{p}_allergy', K.ALLERGY_FACTOR)})"
        base = t if base is None else f"({base} + {t})"
    x = f"({base} + {air_impact()})"
    for flag, factor in K.CONDITION_FACTORS:
        x = f"({x} * {_factor(flag, factor)})"
    x = f"({x} / {K.RISK_DIVISOR!r})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least({x}, 1.0) END)"


def fix6(x: str) -> str:
    """Round half up at 6 decimals, written the same way in both engines."""
    return f"(floor({x} * 1e6 + 0.5) / 1e6)"


def advice_general(score: str) -> str:
    lo, hi = K.GENERAL_CUTS
    return (f"(CASE WHEN {score} IS NULL THEN NULL WHEN {score} < {lo} THEN {q(K.GENERAL_MILD)} "
            f"WHEN {score} < {hi} THEN {q(K.GENERAL_MODERATE)} ELSE {q(K.GENERAL_SEVERE)} END)")


def advice_pollen(p: str) -> str:
    s = pollen_score(p)
    lo, hi = K.CONDITION_CUTS
    t = p.replace("_", " ").title()
    return (f"(CASE WHEN {p}_allergy THEN (CASE WHEN {s} IS NULL THEN NULL WHEN {s} < {lo} THEN {q(t + K.POLLEN_LOW)} "
            f"WHEN {s} < {hi} THEN {q(t + K.POLLEN_MODERATE)} ELSE {q(t + K.POLLEN_HIGH)} END) END)")


def allergic_count() -> str:
    return "(" + " + ".join(f"(CASE WHEN {p}_allergy THEN 1 ELSE 0 END)" for p in K.POLLENS) + ")"


def allergic_mean() -> str:
    total = "0.0"
    for p in K.POLLENS:
        total = f"({total} + (CASE WHEN {p}_allergy THEN {pollen_score(p)} ELSE 0.0 END))"
    n = allergic_count()
    return f"(CASE WHEN {n} > 0 THEN {total} / CAST({n} AS DOUBLE) END)"


def condition_advice(flag: str, texts: tuple) -> str:
    low, mid, high = texts
    lo, hi = K.CONDITION_CUTS
    m = allergic_mean()
    return (f"(CASE WHEN {flag} THEN (CASE WHEN {allergic_count()} = 0 THEN {q(high)} WHEN {m} IS NULL THEN NULL "
            f"WHEN {m} < {lo} THEN {q(low)} WHEN {m} < {hi} THEN {q(mid)} ELSE {q(high)} END) END)")


def advice_cardiac() -> str:
    return f"(CASE WHEN cad THEN {q(K.CARDIAC_TEXT)} END)"


def advice_heart(hr="avg_heart_rate", act="avg_activity_level") -> str:
    return (f"(CASE WHEN {hr} > {K.HEART_HIGH} AND {act} < {K.HEART_HIGH_ACTIVITY} THEN {q(K.HEART_HIGH_TEXT)} "
            f"WHEN {hr} < {K.HEART_LOW} THEN {q(K.HEART_LOW_TEXT)} END)")


def advice_skin(skin="avg_skin_temp") -> str:
    return f"(CASE WHEN {skin} > {K.SKIN_HIGH} THEN {q(K.SKIN_TEXT)} END)"


def advice_activity(hr="avg_heart_rate", eda="avg_eda", act="avg_activity_level") -> str:
    return (f"(CASE WHEN {hr} > {K.ACTIVE_HR} AND {eda} > {K.ACTIVE_EDA} AND {act} > {K.ACTIVE_LEVEL} "
            f"THEN {q(K.ACTIVITY_TEXT)} WHEN {hr} > {K.STRESS_HR} AND {eda} > {K.STRESS_EDA} "
            f"AND {act} < {K.STRESS_LEVEL} THEN {q(K.STRESS_TEXT)} END)")


def advice_parts(score="final_score") -> list[str]:
    return ([advice_general(score)] + [advice_pollen(p) for p in K.POLLENS]
            + [condition_advice("asthma_allergy", K.ASTHMA_TEXTS),
               condition_advice("hay_fever", K.HAY_FEVER_TEXTS),
               condition_advice("eczema", K.ECZEMA_TEXTS),
               advice_cardiac(), advice_heart(), advice_skin(), advice_activity()])


def pollen_class(type_sql: str, conc_sql: str) -> str:
    x = f"coalesce(CASE WHEN isnan({conc_sql}) THEN NULL ELSE {conc_sql} END, 0.0)"
    parts = []
    for name, (b1, b2, b3) in K.POLLEN_CLASS_BOUNDS.items():
        lv = K.POLLEN_LEVELS
        parts.append(f"WHEN {type_sql} = {q(name)} THEN (CASE WHEN {x} <= {b1} THEN {q(lv[0])} WHEN {x} <= {b2} "
                     f"THEN {q(lv[1])} WHEN {x} <= {b3} THEN {q(lv[2])} ELSE {q(lv[3])} END)")
    return f"(CASE {' '.join(parts)} ELSE {q(K.UNKNOWN_POLLEN_LABEL)} END)"


def class_colour(level_sql: str) -> str:
    parts = " ".join(f"WHEN {level_sql} = {q(k)} THEN {q(v)}" for k, v in K.LEVEL_COLOURS.items())
    return f"(CASE {parts} ELSE {q(K.UNKNOWN_COLOUR)} END)"
