"""Bucketed history (K6): slices of a hot site, pruned buckets, newest rows without a shuffle, odd rows."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airwell.sinks.history import history_of_site, newest_of_year, open_bucketed_history, write_bucketed_history

SCHEMA = "municipality_id long, ts timestamp, reading_id long, year int"


def rows_with_a_hot_site():
    """Site 1 holds a third of the rows; two years; ties; no site; no time."""
    out, t0 = [], datetime(2023, 12, 20)
    for i in range(900):
        site = 1 if i % 3 == 0 else 2 + i % 40
        ts = t0 + timedelta(hours=i % 400, minutes=i % 7)
        out.append((site, ts, i, ts.year))
    out += [(5, t0, 10_000, 2023)] * 3
    out += [(None, t0 + timedelta(hours=i), 20_000 + i, 2023) for i in range(30)]
    out += [(1, None, 30_000 + i, None) for i in range(25)]
    return out


@pytest.fixture(scope="module")
def history(spark):
    rows = rows_with_a_hot_site()
    return rows, write_bucketed_history(spark, spark.createDataFrame(rows, SCHEMA), buckets=8, slice_rows=20)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_row_is_kept_and_a_hot_site_is_cut(spark, history):
    rows, h = history
    table = spark.table(h.table)
    got = [(r["municipality_id"], r["ts"], r["reading_id"], r["year"]) for r in table.collect()]
    assert Counter(got) == Counter(rows)
    sizes = {(r["site_slice"], r["year"]): r["count"] for r in table.groupBy("site_slice", "year").count().collect()}
    hot = [n for (s, year), n in sizes.items() if s.startswith("1#") and year == 2024]
    assert len(hot) == 4    # 75 rows
    assert max(n for (_, year), n in sizes.items() if year) <= 20 + 20    # a slice is passed by one hour at most
    assert {s for s, _ in sizes if s.startswith("7#")} == {"7#0"}


def test_slices_follow_time(spark, history):
    _, h = history
    edges = spark.table(h.table).where("municipality_id = 1 and year = 2024").groupBy("slice") \
        .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).orderBy("slice").collect()
    assert [e["slice"] for e in edges] == list(range(len(edges)))
    assert all(newer["lo"] > older["hi"] for newer, older in zip(edges, edges[1:]))
    assert edges[0]["n"] >= 20


def test_newest_rows_need_no_shuffle_and_equal_a_sort(spark, history):
    rows, h = history
    df = newest_of_year(spark, h, 7, ["ts", "reading_id"], years=[2023, 2024])
    assert "Exchange" not in plan_of(df)
    want = defaultdict(list)
    for site, ts, rid, year in rows:
        if year:
            want[site, year].append((ts, rid))
    got = defaultdict(list)
    for r in df.orderBy("rank").collect():
        got[r["municipality_id"], r["year"]].append((r["ts"], r["reading_id"]))
    assert got == {k: sorted(v, reverse=True)[:7] for k, v in want.items()}


@pytest.mark.parametrize("site,year", [(1, 2024), (1, 2023), (9, 2024), (None, 2023), (777, 2024), (9, 1999)])
def test_one_site_is_read_from_its_buckets(spark, history, site, year):
    rows, h = history
    df = history_of_site(spark, h, site, year)
    assert Counter(r["reading_id"] for r in df.collect()) == Counter(r[2] for r in rows if r[0] == site and r[3] == year)


def test_buckets_and_years_are_pruned(spark, history):
    _, h = history
    df = history_of_site(spark, h, 9, 2024)
    per_site = df.groupBy("site_slice").count()
    assert "SelectedBucketsCount: 1 out of 8" in plan_of(per_site)
    assert "Exchange" not in plan_of(per_site)
    assert all("year=2024" in f for f in df.inputFiles())


def test_files_opened_under_another_name(spark, history):
    rows, h = history
    again = open_bucketed_history(spark, h, h.table + "_again")
    assert spark.table(again.table).count() == len(rows)
    df = newest_of_year(spark, again, 2, ["ts", "reading_id"])
    assert "Exchange" not in plan_of(df)
    assert df.count() == newest_of_year(spark, h, 2, ["ts", "reading_id"]).count()


def test_empty_table_and_wrong_calls(spark):
    h = write_bucketed_history(spark, spark.createDataFrame([], SCHEMA), buckets=4, slice_rows=5)
    assert newest_of_year(spark, h, 3, ["ts"]).count() == 0
    assert history_of_site(spark, h, 1, 2024).count() == 0
    with pytest.raises(ValueError):
        newest_of_year(spark, h, 6, ["ts"])
    with pytest.raises(ValueError):
        newest_of_year(spark, h, 3, ["reading_id"])
