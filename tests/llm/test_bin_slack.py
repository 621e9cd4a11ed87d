import random
import zlib
from collections import Counter

import numpy as np
import pytest

from airwell.llm import bin_slack
from airwell.llm.queries import WORD_BPE, op13_min_slack_packing, tokenizer_path
from tests.conftest import SF001


def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    t.no_truncation()
    t.no_padding()
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check(rows, ids_of, capacity):
    """Every id in one piece, pieces end to end in their sequences, no padding."""
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        assert 0 < r.length <= capacity
    assert set(docs) == set(ids_of)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return sequences


def test_query_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    ids = dict(zip((i for i, _ in rows), library_ids([t for _, t in rows])))
    got = op13_min_slack_packing(spark, SF001).collect()
    sequences = check(got, ids, 2048)
    total = sum(map(len, ids.values()))
    assert len(sequences) <= total // 2048 + 11
    pieces = Counter(r.doc_id for r in got)
    cut = sum(pieces[i] > -(-len(x) // 2048) for i, x in ids.items())
    assert cut <= 0.1 * len(ids)


def brute_fill(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    return max(sums)


def test_best_fill_is_closest():
    rng = random.Random(8)
    for _ in range(300):
        counts = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(rng.randrange(0, 7))}
        room = rng.randrange(0, 90)
        used = bin_slack.best_fill(counts, room)
        assert all(0 < used[n] <= counts[n] for n in used)
        assert sum(n * u for n, u in used.items()) == brute_fill(counts, room)


def test_best_fill_takes_long_lengths_first():
    assert bin_slack.best_fill({60: 1, 40: 2, 20: 5, 1: 100}, 100) == {60: 1, 40: 1}


def test_plan_places_every_rest_once():
    rng = random.Random(5)
    for capacity in (8, 64, 100):
        for _ in range(60):
            counts = {rng.randrange(1, capacity): rng.randrange(1, 50) for _ in range(rng.randrange(0, 9))}
            rows, windows, tape = bin_slack.plan(counts, capacity)
            spans, start, at = {}, {}, 0
            for n in sorted(counts, reverse=True):
                start[n], at = at, at + counts[n]
            ends = [*[r[0] for r in rows[1:]], at]
            on_tape, used = [], Counter()
            for (first, one, offset, uses, n, kind), stop in zip(rows.tolist(), ends):
                assert start[n] <= first < stop <= start[n] + counts[n]
                used[n] += stop - first
                for i in range(stop - first):
                    if kind:
                        on_tape.append((one + i * n, n))
                    else:
                        spans.setdefault(one + i // uses, []).append((offset + i % uses * n, n))
            assert used == Counter(counts) and sorted(spans) == list(range(windows))
            for parts in [*spans.values(), on_tape]:
                place = 0
                for low, n in sorted(parts):
                    assert low == place
                    place += n
                assert place == (tape if parts is on_tape else capacity)


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(2)
    counts = {n: rng.randrange(1, 30) for n in range(1, 2048)}
    small = len(bin_slack.plan(counts)[0])
    large = len(bin_slack.plan({n: c * 10 ** 7 for n, c in counts.items()})[0])
    assert large < 3 * small + 2048


@pytest.mark.parametrize("small", [bin_slack.SMALL_TAPE, 0])
def test_slack_is_cut_and_the_end_is_powers_of_two(spark, monkeypatch, small):
    monkeypatch.setattr(bin_slack, "SMALL_TAPE", small)
    # five rests of 5 in windows of 8: no multiset fills one, so all lie on the tape
    docs = spark.createDataFrame([(i, "a b c d") for i in range(5)], "doc_id long, text string")
    rows = bin_slack.pack(docs, tokenizer_path(WORD_BPE), capacity=8).collect()
    sequences = check(rows, dict(enumerate(library_ids(["a b c d"] * 5))), 8)
    assert sorted(sum(n for _, n in p) for p in sequences.values()) == [1, 8, 8, 8]
    assert bin_slack.tape_ends(25, 8).tolist() == [24, 25] and bin_slack.tape_ends(2047 + 4096, 2048)[-1] == 6143


def test_sequences_hold_the_ids(spark):
    texts = ["a b c d", "one two three four five six seven eight nine ten", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bin_slack.sequences(docs, tokenizer_path(WORD_BPE), capacity=8).collect()
    ids = library_ids(texts)
    assert sum(r.n_tokens for r in got) == sum(map(len, ids)) and all(len(r.ids) == 4 * r.n_tokens for r in got)
    flat = Counter(i for r in got for i in np.frombuffer(bytes(r.ids), dtype="<u4").tolist())
    assert flat == Counter(i for x in ids for i in x)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = bin_slack.pack(edge_docs, tokenizer_path(WORD_BPE)).collect()
    ids = library_ids([t for _, t in rows])
    assert sum(r.length for r in got) == sum(map(len, ids))
    for doc in (4, 5, 6):
        assert [(r.start, r.length, r.doc_tokens) for r in got if r.doc_id == doc] == [(0, 1, 1)]
    assert sum(r.length for r in got if r.doc_id == 10) == 2 * len(ids[9])
    assert sum(r.length for r in got if r.doc_id is None) == len(ids[-1])
    by_sequence = Counter()
    for r in got:
        by_sequence[r.sequence_id] += r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in by_sequence.values())
    assert bin_slack.pack(no_docs, tokenizer_path(WORD_BPE)).count() == 0
