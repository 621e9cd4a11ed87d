import hashlib

import pytest

from airwell.llm import sharding


def number(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def brute_table(names, size):
    orders = []
    for s in names:
        offset, skip = number(f"{s}/offset") % size, number(f"{s}/skip") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    owner, n = {}, 0
    while len(owner) < size:
        i = n % len(names)
        owner[next(s for s in orders[i] if s not in owner)] = i
        n += 1
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("shards,size", [(1, 7), (3, 13), (7, 251), (64, 1009)])
def test_table_by_brute_force(shards, size):
    names = [f"shard-{i}" for i in range(shards)]
    table = sharding.lookup_table(names, size)
    assert table == brute_table(names, size)
    counts = [table.count(i) for i in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = [f"shard-{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 6553), sharding.lookup_table(names[:-1], 6553)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.15 * 6553


def test_bad_sizes():
    for names, size in (([], 7), (["a"], 8), (["a"] * 9, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, size)


def test_rows(spark, edge_docs, no_docs, tmp_path):
    table = sharding.lookup_table([f"shard-{i}" for i in range(64)])
    got = sharding.shard(edge_docs).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        slot = number("" if r.doc_id is None else str(r.doc_id)) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.shard(no_docs).count() == 0
    plan = sharding.shard(edge_docs)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    path = str(tmp_path / "shards")
    sharding.write_shards(edge_docs, path, shards=4, table_size=401)
    back = spark.read.parquet(path)
    assert back.count() == edge_docs.count() and set(edge_docs.columns) < set(back.columns)
