"""Driver contract: entry runs, every oracle has a query, names are unique."""

import re

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"user_id", "window_end", "final_score", "advice"} <= set(df.columns)


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 70
    assert set(sql) <= set(qs)
    from airwell.plans import catalog
    for name in catalog.QUERIES:    # the library's own; these names belong to the corpus operators
        assert not re.match(r"^op\d+_", name) and "pipeline" not in name


def test_some_queries_match_oracle_small(spark):
    import duckdb
    from conftest import SF001
    con = duckdb.connect()
    for t in ["customer", "supplier", "lineitem", "events", "nation", "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for name in ["latest_reading", "pollen_scores", "nearest_site", "daily_mean_cover", "cohort_flags"]:
        got = sorted(tuple(str(r[c]) for c in sorted(r.asDict())) for r in qs[name](spark, SF001).collect())
        cur = con.execute(sql[name])
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        exp = sorted(tuple(str(row[i]) for i in order) for row in cur.fetchall())
        assert got == exp, name
