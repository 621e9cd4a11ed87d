"""Latest state in key buckets (K2, K8): only touched buckets are rewritten,
replays change nothing, the folder stays bounded."""

import os
import random

from airwell.session import list_names, new_work_path
from airwell.streaming import buckets as B

SCHEMA = "site long, ts long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state_rows(spark, state):
    return {r["site"]: (r["ts"], r["v"]) for r in B.read_buckets(spark, state).collect()}


def folders(state):
    root = os.path.join(state.replace("file:", ""), "data")
    return sorted((v, b) for v in os.listdir(root) if v.startswith("v=") for b in os.listdir(os.path.join(root, v)) if b.startswith("bucket="))


def test_equal_to_a_dict_over_many_batches(spark):
    rnd, state, want = random.Random(3), new_work_path(spark, "t-buckets"), {}
    for batch in range(9):
        rows = [(rnd.choice([1, 1, rnd.randrange(40)]), rnd.randrange(100), f"{batch}/{i}") for i in range(rnd.choice([0, 3, 30]) if batch else 40)]
        for site, ts, v in rows:
            if (ts, v) > want.get(site, (-1, "")):
                want[site] = (ts, v)
        B.merge_batch(frame(spark, rows + [(None, 1, "x")]), batch, state, "site", ["ts", "v"], buckets=8)
        assert state_rows(spark, state) == want
        assert len(list_names(spark, f"{state}/manifest")) <= 3
    named = {(f"v={v}", f"bucket={b}") for n in list_names(spark, f"{state}/manifest")
             for b, v in B.read_manifest(spark, state, int(n[2:])).items()}
    assert set(folders(state)) == named     # nothing that no kept manifest names


def test_only_touched_buckets_and_replay(spark):
    state = new_work_path(spark, "t-buckets")
    B.merge_batch(frame(spark, [(i, 1, "a") for i in range(200)]), 0, state, "site", ["ts"], buckets=16)
    assert len(folders(state)) == 16
    touched = B.merge_batch(frame(spark, [(5, 2, "b"), (5, 0, "old")]), 1, state, "site", ["ts"], buckets=16)
    assert len(touched) == 1 and [f for f in folders(state) if f[0] == "v=1"] == [("v=1", f"bucket={touched[0]}")]
    before = state_rows(spark, state)
    assert before[5] == (2, "b") and len(before) == 200
    for old in (0, 1):
        assert B.merge_batch(frame(spark, [(5, 9, "again")]), old, state, "site", ["ts"], buckets=16) == []
    assert state_rows(spark, state) == before
    found = B.lookup_key(spark, state, "site", 5, 16)
    assert [(r["site"], r["v"]) for r in found.collect()] == [(5, "b")]
    assert len(found.inputFiles()) == 1
    assert B.lookup_key(spark, state, "site", 777, 16).count() == 0


def test_broken_off_batch_is_completed(spark):
    state = new_work_path(spark, "t-buckets")
    B.merge_batch(frame(spark, [(1, 1, "a")]), 0, state, "site", ["ts"], buckets=2)
    # data written, no manifest: readers do not see it, the replay writes it again
    frame(spark, [(1, 5, "lost")]).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(f"{state}/data/v=1")
    assert state_rows(spark, state) == {1: (1, "a")}
    B.merge_batch(frame(spark, [(1, 5, "b"), (2, 5, "c")]), 1, state, "site", ["ts"], buckets=2)
    assert state_rows(spark, state) == {1: (5, "b"), 2: (5, "c")}


def test_empty_first_batch(spark):
    state = new_work_path(spark, "t-buckets")
    assert B.merge_batch(frame(spark, []), 0, state, "site", ["ts"]) == []
    assert B.read_buckets(spark, state) is None
    B.merge_batch(frame(spark, [(1, 1, "a")]), 1, state, "site", ["ts"])
    assert state_rows(spark, state) == {1: (1, "a")}
