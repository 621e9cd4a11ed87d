"""Scoring rules (R1-R15) against a plain-Python transcription of the
formulas, on hand-made rows that sit on every threshold edge."""

import math

import pytest
from pyspark.sql import functions as F

from airwell import constants as K
from airwell.functions import scoring as S

POLL = K.POLLENS


def py_scores(env, user):
    ps = {p: env[p] * K.POLLEN_WEIGHTS[p] for p in POLL}
    pei = 0
    for p in POLL:
        pei += ps[p]
    aqii = env["european_aqi"]
    for col, cap, mult in K.AQII_TERMS:
        aqii = aqii + (env[col] / cap) * mult
    opii = pei * (env["ozone"] / 120.0)
    pmhi = env["pm10"] * 0.4 + env["pm2_5"] * 0.6
    ceri = min(max((pei + aqii + opii + pmhi) / 2000.0, 0), 1)
    base = 0
    for p in POLL:
        base += ps[p] * 1.0 * 1.5 if user[f"{p}_allergy"] else ps[p] * 1.0
    w = K.RISK_WEIGHTS
    imp = (env["european_aqi"] / 100) * w["aqi"] + (env["pm10"] / 100) * w["pm10"] + \
        (env["pm2_5"] / 100) * w["pm2_5"] + (env["ozone"] / 100) * w["ozone"]
    x = base + imp
    for flag, f in K.CONDITION_FACTORS:
        if user[flag]:
            x *= f
    return dict(pei=pei, aqii=aqii, opii=opii, pmhi=pmhi, ceri=ceri, final=min(x / 15.0, 1.0), ps=ps)


def py_recs(score, user, ps, hr, eda, skin, act):
    out = []
    out.append(K.GENERAL_MILD if score < 0.3 else K.GENERAL_MODERATE if score < 0.7 else K.GENERAL_SEVERE)
    for p in POLL:
        if user[f"{p}_allergy"]:
            t = p.replace("_", " ").title()
            s = ps[p]
            out.append(t + (K.POLLEN_LOW if s < 0.5 else K.POLLEN_MODERATE if s < 0.8 else K.POLLEN_HIGH))
    allergic = [ps[p] for p in POLL if user[f"{p}_allergy"]]
    m = sum(allergic) / len(allergic) if allergic else float("nan")
    for flag, texts in (("asthma_allergy", K.ASTHMA_TEXTS), ("hay_fever", K.HAY_FEVER_TEXTS), ("eczema", K.ECZEMA_TEXTS)):
        if user[flag]:
            out.append(texts[0] if m < 0.5 else texts[1] if m < 0.8 else texts[2])
    if user["cad"]:
        out.append(K.CARDIAC_TEXT)
    if hr > 100 and act < 0.3:
        out.append(K.HEART_HIGH_TEXT)
    elif hr < 50:
        out.append(K.HEART_LOW_TEXT)
    if skin > 37.5:
        out.append(K.SKIN_TEXT)
    if hr > 120 and eda > 9.8 and act > 0.7:
        out.append(K.ACTIVITY_TEXT)
    elif hr > 99 and eda > 9.9 and act < 0.3:
        out.append(K.STRESS_TEXT)
    return out


FLAGS = [f"{p}_allergy" for p in POLL] + ["asthma_allergy", "hay_fever", "eczema", "cad"]


def make_rows():
    rows = []
    levels = [0.0, 0.3, 1 / 3, 0.5, 0.8 / 1.5, 0.8, 2.0, 15.0, 16.0, 1500.0]
    vit = [(100.0, 9.9, 37.5, 0.3), (100.5, 9.95, 37.6, 0.29), (49.9, 1.0, 33.0, 0.5), (120.5, 9.81, 36.0, 0.71),
           (99.5, 10.0, 38.0, 0.1)]
    for i, lv in enumerate(levels):
        for j in range(6):
            env = {p: lv * (1 + k * 0.1) for k, p in enumerate(POLL)}
            env.update(european_aqi=10.0 * i, pm10=5.0 * j, pm2_5=2.5 * i, nitrogen_dioxide=1.0, sulphur_dioxide=2.0,
                       carbon_monoxide=100.0 * j, ozone=30.0 * i)
            user = {f: bool((i * 7 + j * 3 + n) % (2 + n % 3) == 0) for n, f in enumerate(FLAGS)}
            if j == 0:   # no allergy at all, with conditions (the undefined mean)
                user.update({f"{p}_allergy": False for p in POLL}, asthma_allergy=True, hay_fever=True, eczema=True)
            hr, eda, skin, act = vit[(i + j) % len(vit)]
            rows.append(dict(env, **user, avg_heart_rate=hr, avg_eda=eda, avg_skin_temp=skin,
                             avg_activity_level=act))
    return rows


def test_scores_match_python(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows)
    out = S.with_scores(df).collect()
    for r, o in zip(rows, out):
        exp = py_scores(r, r)
        for k in ("pei", "aqii", "opii", "pmhi", "ceri"):
            assert o[k] == pytest.approx(exp[k], rel=1e-12, abs=1e-12), k
        assert o["final_score"] == pytest.approx(exp["final"], rel=1e-12)
        assert 0 <= o["ceri"] <= 1 and o["final_score"] <= 1
        recs = py_recs(o["final_score"], r, exp["ps"], r["avg_heart_rate"], r["avg_eda"], r["avg_skin_temp"],
                       r["avg_activity_level"])
        assert list(o["recommendations"]) == recs


def test_null_reading_propagates(spark):
    row = make_rows()[5]
    row["mugwort_pollen"] = None
    row["mugwort_pollen_allergy"] = True
    df = spark.createDataFrame([row], schema=spark.createDataFrame(make_rows()).schema)
    o = S.with_scores(df).first()
    assert o["pei"] is None and o["final_score"] is None and o["ceri"] is None
    assert o["recommendations"][0] != K.GENERAL_MILD  # general advice skipped (NULL score)
    assert not any(t.startswith("Mugwort") for t in o["recommendations"])


def test_missing_profile_gives_null_score(spark):
    row = make_rows()[7]
    schema = spark.createDataFrame(make_rows()).schema
    for f in FLAGS:
        row[f] = None
    o = S.with_scores(spark.createDataFrame([row], schema=schema)).first()
    assert o["final_score"] is None
    assert o["pei"] is not None


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (3.0,)], "x double")
    got = [r[0] for r in df.select(S.clamp01_guarded(F.col("x"))).collect()]
    assert got == [None, 0.0, 0.5, 1.0]


def test_fix6_half_up(spark):
    df = spark.createDataFrame([(84.8174335,), (1.0000005,), (-2.5e-7,), (None,)], "x double")
    got = [r[0] for r in df.select(S.fix6("x")).collect()]
    assert got[0] == math.floor(84.8174335 * 1e6 + 0.5) / 1e6
    assert got[3] is None
