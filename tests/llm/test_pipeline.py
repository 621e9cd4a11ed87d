import corpus_pipeline
from airwell.llm import langid, minhash, packing, pii, quality
from airwell.llm.queries import WORD_BPE, tokenizer_path
from tests.conftest import SF001
from tests.llm.test_minhash import brute


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "dedup", "pii", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if name == "packing":
            ids = {r.doc_id for r in before}
            assert {r.doc_id for r in after} == ids and "sequence_id" in out.columns
            break
        assert out.columns == names
        if name == "quality":
            verdict = {r.doc_id: r.kept for r in quality.score(docs).collect()}
            assert {r.doc_id for r in after} == {i for i, k in verdict.items() if k}
            assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()
        elif name == "language":
            told = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
            assert {r.doc_id for r in after} == {i for i, r in told.items() if r.lang_pred != "und" and not r.ambiguous}
            assert len(after) >= 0.98 * len(before)
        elif name == "dedup":
            comp = brute([(r.doc_id, r.text) for r in before], 80)
            assert {r.doc_id for r in after} == {i for i, c in comp.items() if i == c}
        elif name == "pii":
            assert {r.doc_id: r.text for r in after} == {r.doc_id: pii.redact(r.text) for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        docs = out


def test_run_gives_the_last_stage(spark):
    a = corpus_pipeline.run(spark, SF001).collect()
    assert a and all(r.length <= packing.CAPACITY for r in a)


def test_stages_bear_edge_rows_and_empty_tables(spark, edge_docs, no_docs, tmp_path):
    for start, rows in (("edge", edge_docs), ("empty", no_docs)):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF001).write.parquet(str(tmp_path / start / name))
            docs = spark.read.parquet(str(tmp_path / start / name))
        ids = {r.doc_id for r in docs.collect()}
        assert 11 in ids and 12 not in ids if start == "edge" else not ids


def test_tokenizer_is_found_and_used():
    assert tokenizer_path(WORD_BPE).endswith(WORD_BPE) and minhash.SHINGLE == 5
