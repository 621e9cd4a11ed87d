import hashlib
from collections import Counter, defaultdict

import numpy as np

from airwell.llm import align
from airwell.llm._encode import byte_symbols
from airwell.llm.queries import BYTE_BPE, PIECE_BPE, op11_token_alignment, tokenizer_path
from tests.conftest import SF001

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """Ids and bytes of both tokenizers, by the libraries on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    byte = {s: i for i, s in enumerate(byte_symbols())}

    def both(t):
        if not t:
            return None
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = (" " + t).encode()
        return (x, xb, y, yb) if b"".join(xb) == raw == b"".join(yb) else None
    return both(text)


def brute(texts):
    groups = []
    for t in texts:
        found = tokens(t)
        if found is None:
            groups.append([])
            continue
        x, xb, y, yb = found
        out, now, i, j, a, b = [], ([], []), 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if a <= b:
                now[0].append(x[i])
                a, i = a + len(xb[i]), i + 1
            else:
                now[1].append(y[j])
                b, j = b + len(yb[j]), j + 1
            if a == b:
                out.append(now)
                now = ([], [])
        groups.append(out)
    links = [Counter((p, q) for g in doc for p in g[0] for q in g[1]) for doc in groups]
    count = Counter(k for n in links for k in n)
    top = defaultdict(int)
    for (p, _), c in count.items():
        top[p] = max(top[p], c)
    join = lambda ids: ",".join(map(str, ids))
    return [(sum(len(g[0]) for g in doc), sum(len(g[1]) for g in doc), len(doc), sum(n.values()),
             sum(v for k, v in n.items() if count[k] == top[k[0]]), sum(v * count[k] for k, v in n.items()),
             hashlib.sha256(";".join(f"{join(g[0])}|{join(g[1])}" for g in doc).encode()).hexdigest() if doc else "")
            for doc, n in zip(groups, links)], count


def test_merge_paths_find_the_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a, b = (np.unique(rng.integers(1, 80, rng.integers(0, 40))) for _ in range(2))
        piece = int(rng.integers(1, 12))
        i, j = align.path_splits(a, b, piece)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and i[-1] == len(a) and j[-1] == len(b)
        work = np.diff(i) + np.diff(j)
        assert not len(work) or work.max() <= piece + 1        # equal work, but for an end that stays with its equal
        x, y = align.common_ends(a, b, piece)
        both = np.intersect1d(a, b)
        assert np.array_equal(a[x - 1], both) and np.array_equal(b[y - 1], both)


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want, _ = brute([t for _, t in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")     # several blocks
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op11_token_alignment(spark, SF001).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {d: w for (d, _), w in zip(rows, want)}


def test_small_pieces_and_wide_groups_give_the_same(monkeypatch):
    texts = ["<|endoftext|> and ▁ x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "日本語のテキスト 12345678901234567890 \n\n  tabs\t", "𝔘𝔫𝔦 ☃ é"]
    a_model, b_model = align.rank_encoder(tokenizer_path(BYTE_BPE), literal=True), align.piece_model(tokenizer_path(PIECE_BPE))
    len_a = np.array([len(a_model.bytes.get(i, b"")) for i in range(max(a_model.bytes) + 1)])
    len_b = np.array([len(x) for x in b_model.bytes])

    def rows():
        block = align._Block(0)
        block.add((len_a, len_b, [align._tokens(a_model, b_model, t) for t in texts]))
        return [(*r[:5], r[5].tolist(), r[6].tolist()) for r in block.rows]
    first = rows()
    want, _ = brute(texts)
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in first] == [(w[0], w[1], w[2], w[3], w[6]) for w in want]
    monkeypatch.setattr(align, "WIDE", 1)
    monkeypatch.setattr(align.common_ends, "__defaults__", (3,))
    assert rows() == first


def test_a_text_longer_than_a_piece_is_stitched(spark):
    text = " ".join(f"harbour{i % 401} unbelievably {i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "harbour1 unbelievably 1")], "doc_id long, text string")
    want, _ = brute([text, "harbour1 unbelievably 1"])
    got = align.align(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == want and want[0][0] > 2 * align.PIECE


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()] + [(20, "▁ turns to a space"), (21, " lead"), (22, "<|endoftext|>")]
    docs = edge_docs.select("doc_id", "text", "kept", "pos").union(
        spark.createDataFrame([(i, t, "k", "p") for i, t in rows[-3:]], "doc_id long, text string, kept string, pos string"))
    want, count = brute([t for _, t in rows])
    got = align.align(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, *(r[c] for c in COLUMNS)) for r in got], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)
    by_id = {r.doc_id: r for r in got}
    assert all(tuple(by_id[i])[1:] == (0, 0, 0, 0, 0, 0, "") for i in (4, 5, 20)) and by_id[22].n_a > 1
    assert align.align(no_docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)).count() == 0
    table = align.pair_counts(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in table} == dict(count)


def test_groups_cover_the_text(spark):
    text = "Der Hund café — 12,5 ½"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = sorted(align.groups(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)).collect(), key=lambda r: r.start)
    x, _, y, _ = tokens(text)
    assert [i for r in got for i in r.a_ids] == x and [i for r in got for i in r.b_ids] == y
    assert [r.start for r in got] == [0, *(r.end for r in got[:-1])] and got[-1].end == len((" " + text).encode())
