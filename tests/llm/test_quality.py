import math
import re

from airwell.llm import quality
from tests.llm.conftest import edge_rows
from tests.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def histograms(text):
    words = WORD.findall(text)
    classes = [len(re.findall(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[.,;:!?'()\"-]", r"[#*$%&|<>]")]
    letters = sum(map(len, words))
    common = list(dict.fromkeys(w for ws in quality.COMMON_WORDS.values() for w in ws))
    counts = [sum(x in (w, w.capitalize()) for x in words) for w in common]
    return [*classes, letters - sum(classes), len(text) - letters], counts, len(words)


def jsd(p, q):
    p, q = [x / max(sum(p), 1e-12) for x in p], [x / max(sum(q), 1e-12) for x in q]
    part = lambda a, m: a * math.log2(a / m) if a > 0 else 0
    return math.sqrt(max(0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q))))


def check(rows, got):
    refs = {}
    for _, text, lang in rows:
        if lang in quality.COMMON_WORDS:
            c, w, n = histograms(text or "")
            refs.setdefault(lang, []).append(([x / max(sum(c), 1) for x in c], [x / max(n, 1) for x in w]))
    mean = lambda vs: [sum(x) / len(vs) for x in zip(*vs)]
    refs = [(mean([c for c, _ in v]), mean([w for _, w in v])) for v in refs.values()]
    refs = [(c, [*w, max(0, 1 - sum(w))]) for c, w in refs]
    got = sorted(((r.doc_id, r.text_key), r) for r in got) if False else got
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, r)
    for doc_id, text, _ in rows:
        r, want = by_id[doc_id], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, doc_id
        c, w, n = histograms(text or "")
        w = [*w, max(0, n - sum(w))]
        char = min((jsd(c, q) for q, _ in refs), default=None) if len(text or "") >= quality.GUARD_CHARS else None
        word = min((jsd(w, q) for _, q in refs), default=None) if n >= quality.GUARD_WORDS else None
        for a, b in ((r.char_jsd, char), (r.word_jsd, word)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
        far = (char or 0) > quality.MAX_CHAR_JSD or ((char or 0) > quality.BOTH_CHAR_JSD and (word or 0) > quality.BOTH_WORD_JSD)
        assert r.kept == (not r.base_failed and not far)


def test_counts_distances_and_verdict_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    check(rows, quality.score(docs).collect())


def test_edge_rows(edge_docs):
    got = quality.score(edge_docs).collect()
    assert len(got) == len(edge_rows())
    check([(r[0], r[1], r[2]) for r in edge_rows()], got)


def test_without_references_only_the_fixed_rules_decide(edge_docs):
    got = quality.score(edge_docs.filter("lang is null")).collect()
    assert all(r.char_jsd is None and r.kept == (not r.base_failed) for r in got)


def test_filter_keeps_columns_and_whole_rows(edge_docs, no_docs):
    kept = quality.filter_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    verdict = [r.kept for r in quality.score(edge_docs).collect()]
    assert kept.count() == sum(verdict)
    assert quality.filter_documents(no_docs).count() == 0
    assert quality.score(no_docs).count() == 0


def test_no_python_in_the_plan(spark, edge_docs):
    plan = quality.features(edge_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_windows_of_equal_hash_are_compared_by_words(spark):
    """Third words made so that two different windows have the same 64-bit hash."""
    p1, p2, p5, top = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 1 << 64
    turn = lambda x, n: (x << n | x >> (64 - n)) % top
    hashes = [r.h % top for r in spark.range(60_000).selectExpr("xxhash64(concat('a', id), 'b') as h").collect()]
    first = (hashes[0] + p5 + 8) % top ^ turn(int.from_bytes(b"ordinary", "little") * p2 % top, 31) * p1 % top
    made = []
    for i, h in enumerate(hashes[1:], 1):
        k = turn((first ^ (h + p5 + 8) % top) * pow(p1, -1, top) % top, 33) * pow(p2, -1, top) % top
        word = k.to_bytes(8, "little")
        if all(0x21 <= c <= 0x7E for c in word):
            made.append(f"a{i} b {word.decode()}")
    one, two = "a0 b ordinary", made[0]
    texts = [f"{one} x {two} y", f"{one} x {two} y {one} z", f"{two} x {one} y {two} z {one}", f"{one} {one} {two}", one, ""]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.n_repeat_words for r in quality.features(docs).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}
