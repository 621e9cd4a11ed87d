"""As-of join (J5) = brute force; interpolation (W2) = pandas; lags (W1);
daily rollups (A2); latest per key (A4); upsert (K7); top-k (U3)."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from airwell.operators import features as W
from airwell.operators.asof import asof_join, latest_per_key
from airwell.operators.latest import newest_per_key, upsert

T0 = dt.datetime(2024, 1, 1)


def test_asof_equals_brute_force(spark):
    rnd = random.Random(3)
    right = []
    for k in (1, 2, 3):
        t = T0
        for i in range(60):
            t += dt.timedelta(hours=rnd.choice([1, 1, 2, 30, 70]))   # gaps of several days
            right.append((k, t, i, float(rnd.randint(0, 3))))
            if rnd.random() < 0.2:
                right.append((k, t, i + 1000, 9.0))                  # duplicate time: higher id wins
    left = [(n, rnd.choice([1, 2, 3, 4]), T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 120))) for n in range(400)]
    L = spark.createDataFrame(left, "n long, k long, t timestamp")
    Rr = spark.createDataFrame(right, "k long, rt timestamp, rid long, v double")
    got = {r["n"]: (r["rid"]) for r in asof_join(L, Rr, "k", "t", "rt", bucket_seconds=86400,
                                                  tie_order=["rid", "v"]).collect()}
    for n, k, t in left:
        cands = [(rt, rid, v) for kk, rt, rid, v in right if kk == k and rt <= t]
        exp = max(cands)[1] if cands else None
        assert got[n] == exp, (n, k, t)
    # a left side that starts late: earlier right rows only count through each key's last one
    late = [(n, k, t) for n, k, t in left if t > T0 + dt.timedelta(days=60)]
    L2 = spark.createDataFrame(late, "n long, k long, t timestamp")
    got2 = {r["n"]: r["rid"] for r in asof_join(L2, Rr, "k", "t", "rt", tie_order=["rid", "v"]).collect()}
    for n, k, t in late:
        cands = [(rt, rid, v) for kk, rt, rid, v in right if kk == k and rt <= t]
        assert got2[n] == (max(cands)[1] if cands else None), (n, k, t)


def test_interpolate_matches_pandas(spark):
    vals = [None, None, 1.0, None, None, 4.0, 5.0, None, 2.0, None, None]
    rows = [(k, i, v) for k in (1, 2) for i, v in enumerate(vals if k == 1 else [None, 3.0, None])]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {(r["k"], r["i"]): r["f"] for r in W.interpolate_fill(df, "k", "i", "v", "f").collect()}
    for k in (1, 2):
        s = pd.Series([v for kk, i, v in rows if kk == k], dtype="float64")
        exp = s.interpolate().bfill().ffill()
        for i, e in enumerate(exp):
            assert abs(got[(k, i)] - e) < 1e-12


def test_lags_per_key(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0), (1, 3, 12.0), (2, 1, 20.0), (2, 2, 21.0)],
                               "k long, d long, v double")
    out = {(r["k"], r["d"]): (r["v_lag_1"], r["v_lag_2"]) for r in W.lags(df, "k", "d", "v", 3).collect()}
    assert out[(1, 3)] == (11.0, 10.0) and out[(2, 1)] == (None, None) and out[(2, 2)] == (20.0, None)


def test_daily_cover_rule(spark):
    rows = [(1, T0 + dt.timedelta(hours=h), None if h < 2 else 1.0 * h) for h in range(4)]   # 2 of 4 present
    rows += [(2, T0 + dt.timedelta(hours=h), None if h < 3 else 5.0) for h in range(4)]       # 1 of 4 present
    df = spark.createDataFrame(rows, "k long, ts timestamp, v double")
    got = {r["k"]: r["v"] for r in W.daily_mean_with_cover(df, "k", "ts", ["v"]).collect()}
    assert got == {1: 2.5, 2: None}


def test_latest_upsert_topk(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (1, 7, 3), (2, 1, 1)], "k long, ts long, id long")
    got = {r["k"]: r["id"] for r in latest_per_key(df, ["k"], ["ts", "id"]).collect()}
    assert got == {1: 3, 2: 1}
    top = newest_per_key(df, "k", ["ts", "id"], 2).collect()
    assert sorted((r["k"], r["id"], r["rank"]) for r in top) == [(1, 2, 2), (1, 3, 1), (2, 1, 1)]
    cur = spark.createDataFrame([(1, 10.0, 1), (2, 20.0, 1)], "user_id long, bmi double, load_seq int")
    upd = spark.createDataFrame([(2, 21.0, 2), (3, 30.0, 2)], "user_id long, bmi double, load_seq int")
    got = sorted(tuple(r) for r in upsert(cur, upd, "user_id").select("user_id", "bmi", "load_seq").collect())
    assert got == [(1, 10.0, 1), (2, 21.0, 2), (3, 30.0, 2)]


def test_asof_reads_the_right_side_once(spark, monkeypatch, tmp_path):
    """One scan of the right side, without the rows of keys that no left row has; many keys, or a unique right side, give the same."""
    from airwell.operators import asof as A
    right = [(k, T0 + dt.timedelta(hours=7 * i), i, float(i)) for k in range(6) for i in range(40)]
    spark.createDataFrame(right, "k long, rt timestamp, rid long, v double").write.parquet(f"{tmp_path}/right")
    Rr = spark.read.parquet(f"{tmp_path}/right")
    left = [(n, n % 3 + 4, T0 + dt.timedelta(hours=100 + 11 * n)) for n in range(30)]
    L = spark.createDataFrame(left, "n long, k long, t timestamp")
    exp = {n: max([rid for kk, rt, rid, _ in right if kk == k and rt <= t], default=None) for n, k, t in left}
    plans, plain = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    for bound, ties in ((500_000, ["rid", "v"]), (0, ["rid", "v"]), (500_000, None)):
        monkeypatch.setattr(A, "MAX_SENT_KEYS", bound)
        plans.clear()
        got = {r["n"]: r["rid"] for r in A.asof_join(L, Rr, "k", "t", "rt", tie_order=ties).collect()}
        assert got == exp
        if ties:
            assert plans[-1].count("rid#") and sum("Relation" in x and "rid#" in x for x in plans[-1].splitlines()) == 1
        assert ("LeftSemi" in plans[-1]) == (bound > 0)


def test_entries_of_a_list_are_computed_once(spark):
    """Exploding a computed list must not compute it again for a filter below."""
    from airwell.operators.latest import advice_items, latest_by_category
    t = [T0 + dt.timedelta(minutes=i) for i in range(4)]
    rows = [("1", t[0], "A: old", "B: x"), ("1", t[2], "A: new", None), ("1", t[1], "A: mid", "no category"), ("2", t[3], None, None)]
    df = spark.createDataFrame(rows, "user_id string, window_end timestamp, p string, q string")
    s = df.withColumn("recommendations", F.array_compact(F.array(F.upper("p"), F.upper("q"))))
    items = advice_items(s, "user_id", "window_end")
    assert items._jdf.queryExecution().optimizedPlan().toString().count("upper(p") == 1
    assert sorted(r["advice"] for r in items.collect()) == ["A: MID", "A: NEW", "A: OLD", "B: X", "NO CATEGORY"]
    got = {(r["user_id"], r["category"]): (r["content"], r["window_end"]) for r in latest_by_category(items).collect()}
    assert {k: v[0] for k, v in got.items()} == {("1", "A"): "NEW", ("1", "B"): "X"}
