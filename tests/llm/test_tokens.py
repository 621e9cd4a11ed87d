import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from airwell.llm import bpe, packing, token_orc
from airwell.llm._encode import Encoder
from airwell.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path
from tests.conftest import SF001

ODD = ["  a  b \n c  ", "\n\n x\t y ", "a  ", "  ", "", "x <|endoftext|> y<|endoftext|>z <|startoftext|>", "it's we'll don't I'VE",
       "ÀÉ été Straße ΑΣ ΣΑΣ İstanbul", "a. b, c.. d!. 1. 2,", "é    x　y  z", "tab\tsep \x1c x\x1dy \x85 z", "٣.٤, 五. ².",
       " .", " ,a", "Á̧ b̧́", "foo_. bar-, x.", "Ǆ ŉ ﬁ Å", "a \xa0b\xa0 c", "  \nb", "x \x1f y", "<| a <|x|>", "aaaaaaaaaaaaaaaa", "!!!!!!!!!!",
       "hahahahaha", "x" * 3000]


def library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def texts(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdeénßt12.-' \n") for _ in range(60)) for _ in range(300)]
    return [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()] + ODD + made


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_word_tables_give_the_library_ids(spark, name):
    t, e = library(name), Encoder(tokenizer_path(name))
    some = texts(spark)
    for _ in range(2):      # the second time from the table
        for want, got in zip(t.encode_batch(some, add_special_tokens=False), e.encode(some)):
            assert want.ids == got.tolist()


def test_a_tokenizer_with_other_rules_is_used_whole(tmp_path):
    import json
    told = json.load(open(tokenizer_path(BYTE_BPE), encoding="utf-8"))
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told))
    t, e = Tokenizer.from_file(str(path)), Encoder(str(path))
    assert e.kind is None
    assert [x.tolist() for x in e.encode(["a b  c", "", None])] == [t.encode("a b  c", add_special_tokens=False).ids, [], []]


def test_automaton_gives_the_library_ids_and_texts(spark):
    t, a = library(WORD_BPE), bpe.automaton(tokenizer_path(WORD_BPE))
    some = texts(spark)
    for text, got in zip(some, a.encode(some)):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got == ids
        assert a.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_automaton_paths_are_the_tokenizations():
    """A label sequence is a path if and only if the library encodes its text to it."""
    a, t, rng = bpe.automaton(tokenizer_path(WORD_BPE)), library(WORD_BPE), random.Random(4)
    plain = [s for s in a.ids if s.isalpha() and s.isascii() and s == s.lower()]
    seen = set()
    for _ in range(4000):
        u, v = rng.choice(plain), rng.choice(plain) + a.end
        if v not in a.by_text:
            continue
        ids = t.encode(u + v.removesuffix(a.end), add_special_tokens=False).ids
        arc = a.arc(a.ids[u], a.ids[v])
        assert arc == (ids == [a.ids[u], a.ids[v]])
        seen.add(arc)
    assert seen == {True, False}


def test_automaton_frames(spark, edge_docs, no_docs):
    path = tokenizer_path(WORD_BPE)
    t = library(WORD_BPE)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in edge_docs.collect()}
    ids = bpe.encode(edge_docs, path)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: r.text for r in bpe.decode(ids, path).collect()} == {
        i: t.decode(x, skip_special_tokens=False) for i, x in want.items()}
    for r in bpe.digests(edge_docs, path).collect():
        x = want[r.doc_id]
        assert r.n_tokens == len(x)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(no_docs, path).count() == 0


def test_orc_round_trip(spark, edge_docs, no_docs):
    path = tokenizer_path(BYTE_BPE)
    t = library(BYTE_BPE)
    for docs in (edge_docs, spark.read.parquet(f"{SF001}/documents.parquet")):
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
        got = sorted(token_orc.digests(spark, token_orc.round_trip(docs, path)).collect(), key=lambda r: r.start)
        start = 0
        for (doc_id, text), r in zip(rows, got):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert len(rows) == len(got)
    assert token_orc.digests(spark, token_orc.round_trip(no_docs, path)).count() == 0


def test_orc_files_carry_bloom_filters_and_prune(spark):
    from pyarrow import orc as pa_orc
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    folder = token_orc.round_trip(docs, tokenizer_path(BYTE_BPE))
    ids = [r.doc_id for r in token_orc.lookup(spark, folder, [3, 5, 10 ** 9]).collect()]
    assert sorted(ids) == [3, 5]
    plan = token_orc.lookup(spark, folder, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    import glob
    files = glob.glob(folder.replace("file:", "") + "/*.orc")
    stripes = [pa_orc.ORCFile(f).nstripes for f in files]
    assert files and min(stripes) >= 1
    rows = token_orc.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and all(len(r.ids) == r.n_tokens for r in rows)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    import bisect
    gaps = []
    n = 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        if k < len(gaps):
            rest = gaps.pop(k) - x
        else:
            n, rest = n + 1, capacity - x
        bisect.insort(gaps, rest)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_rounds_pack_as_well_as_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = 64
    lengths = [rng.choice([1, 2, 3, 7, 20, 21, 22, 33, 40, 64, rng.randint(1, 64)]) for _ in range(3000)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    table = packing.plan(counts, capacity)
    pos = np.arange(len(lengths))
    at = np.searchsorted(table[:, 0], pos, side="right") - 1
    sequence, offset = table[at, 1] + pos - table[at, 0], table[at, 2]
    from collections import namedtuple
    Row = namedtuple("Row", "sequence_id offset length")
    rows = [Row(s, o, x) for s, o, x in zip(sequence, offset, sorted(lengths, reverse=True))]
    assert check_packing(rows, capacity) == best_fit_decreasing(lengths, capacity)


def test_packing_of_documents(spark, edge_docs, no_docs):
    t, path = library(WORD_BPE), tokenizer_path(WORD_BPE)
    for docs in (edge_docs, spark.read.parquet(f"{SF001}/documents.parquet")):
        rows = packing.pack(docs, path).collect()
        pieces, lengths = [], []
        for r in docs.collect():
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            for n, low in enumerate(range(0, len(ids), 2048)):
                part = ids[low:low + 2048]
                pieces.append((r.doc_id or -1, n, low, len(part), zlib.crc32(part.tobytes())))
                lengths.append(len(part))
        assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces)
        assert check_packing(rows, 2048) <= best_fit_decreasing(lengths, 2048)
    assert packing.pack(no_docs, path).count() == 0


def test_sequences_hold_the_ids(spark, edge_docs):
    path = tokenizer_path(WORD_BPE)
    rows = packing.sequences(edge_docs, path, capacity=256).collect()
    assert all(len(r.ids) == r.n_tokens <= 256 for r in rows)
    total = sum(len(library(WORD_BPE).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge_docs.collect())
    assert sum(r.n_tokens for r in rows) == total


def test_rank_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    from airwell.llm import _encode
    from airwell.llm.queries import BYTE_BPE, tokenizer_path
    path = tokenizer_path(BYTE_BPE)
    plain, literal = _encode.RankEncoder(path), _encode.RankEncoder(path, literal=True)
    assert plain.core is not None
    one, two = Tokenizer.from_file(path), Tokenizer.from_file(path)
    two.encode_special_tokens = True
    rng = random.Random(1)
    letters = "ab cdéE'stL l 1 2\n\t  \x85\xa0\x1c\x1d​ßЖж漢ñ.,!-_́ \x01 𝔘<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [t + "<|endoftext|> x" for t in texts[:100]] + [" " * 5000 + "x", "\n \n" * 2000, "a" * 3000, "don't we'll I'D 's"]
    for t in texts:
        assert plain.ids(t) == one.encode(t, add_special_tokens=False).ids
        assert literal.ids(t) == two.encode(t, add_special_tokens=False).ids
