import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from airwell.llm import langid
from tests.conftest import SF01


def test_held_out_accuracy_and_training_split(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.fit(docs)
    truth = {r.doc_id: r for r in docs.select("doc_id", "lang", "n_chars", langid.held_out(docs.doc_id).alias("out")).collect()}
    got = langid.predict(docs, model).collect()
    assert len(got) == len(truth)
    assert all(truth[r.doc_id].out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if truth[r.doc_id].out]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in tested)
    assert right / len(tested) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_the_held_out_part_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


FOREIGN = [
    "A nagy folyó partján állt egy régi malom, ahol a falu népe minden ősszel összegyűlt, hogy lisztet őröljön a télre. A molnár lánya énekelt. ",
    "Na břehu velké řeky stál starý mlýn, kde se lidé z vesnice každý podzim scházeli, aby si namleli mouku na zimu. Mlynářova dcera zpívala. ",
    "Nad brzegiem wielkiej rzeki stał stary młyn, gdzie ludzie ze wsi zbierali się każdej jesieni, aby zemleć mąkę na zimę. Córka śpiewała. ",
    "Suuren joen rannalla seisoi vanha mylly, jonne kylän väki kokoontui joka syksy jauhamaan jauhoja talveksi. Myllärin tytär lauloi. ",
    "Büyük nehrin kıyısında eski bir değirmen vardı; köylüler her sonbahar kış için un öğütmek üzere orada toplanırdı. Çark yavaşça dönerdi. ",
    "На берегу большой реки стояла старая мельница, где жители деревни каждую осень собирались, чтобы смолоть муку на зиму. Дочь пела. ",
    "Στην όχθη του μεγάλου ποταμού βρισκόταν ένας παλιός μύλος, όπου οι άνθρωποι του χωριού μαζεύονταν κάθε φθινόπωρο για να αλέσουν αλεύρι. ",
    "大きな川の岸に古い水車小屋があり、村の人々は毎年秋になると冬のための粉を挽くために集まった。粉屋の娘は歌い、車輪は回っていた。",
    "Sulla riva del grande fiume si trovava un vecchio mulino, dove la gente del villaggio si riuniva ogni autunno per macinare la farina. ",
    "Na margem do grande rio havia um velho moinho, onde o povo da aldeia se reunia todos os outonos para moer a farinha para o inverno. "]


def planted(docs, n=150):
    """Held-out texts of at least 50 words by language, and texts mixed word by word from two of them."""
    rng = random.Random(7)
    by = {}
    for r in docs.filter(langid.held_out(docs.doc_id)).filter("lang is not null").collect():
        if r.text and len(r.text.split()) >= 50 and len(set(r.text.split())) >= 30:
            by.setdefault(r.lang, []).append(r.text)
    mixed = []
    for _ in range(n):
        a, b = rng.sample(sorted(by), 2)
        x, y = rng.choice(by[a]).split(), rng.choice(by[b]).split()
        mixed.append(" ".join(w for pair in zip(x, y) for w in pair))
    return [t for texts in by.values() for t in texts], mixed


def test_mixed_and_foreign_texts_are_flagged_and_clean_ones_are_not(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    clean, mixed = planted(docs)
    model = langid.fit(docs)
    flagged = lambda texts: np.mean(langid._decide(model, texts)[2])
    assert flagged(clean) <= 0.01 and len(clean) > 100
    assert flagged(mixed) >= 0.9
    assert flagged([t * 3 for t in FOREIGN]) >= 0.9


def test_filter_rejects_planted_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    clean, mixed = planted(docs, 60)
    bad = mixed + [t * 3 for t in FOREIGN]
    rows = [(10 ** 6 + i, t, None, "planted", len(t)) for i, t in enumerate(bad)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(extra)
    kept = {r.doc_id for r in langid.filter_documents(both).collect()}
    assert sum(r[0] in kept for r in rows) <= 0.1 * len(rows)
    long = [r.doc_id for r in docs.collect() if r.text and len(set(r.text.split())) >= 50]
    assert sum(i not in kept for i in long) <= 0.01 * len(long)


def test_decoding_against_plain_sums():
    """The nearest codeword by loops over bits, from weights drawn at random."""
    rng = np.random.default_rng(3)
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, rng.standard_normal((langid.DIMENSIONS + 1, code.shape[1])).astype(np.float32),
                         rng.random(code.shape[1]).astype(np.float32), np.full(langid.SIZES, 0.05))
    x, grams = langid._histograms(["some words", "other words here", "ein Satz", "x", ""])
    best, score, unsure = model.decode(x, grams)
    for i in range(len(x)):
        loss = []
        for word in code:
            total = 0.0
            for b, bit in enumerate(word):
                margin = sum(float(x[i, j]) * float(model.weights[j, b]) for j in np.flatnonzero(x[i])) + float(model.weights[-1, b])
                total += float(model.bit_weights[b]) * float(np.log1p(np.exp(-float(bit) * margin)))
            loss.append(total)
        assert best[i] == int(np.argmin(loss)) and abs(score[i] - 1 / sum(np.exp(min(loss) - v) for v in loss)) < 1e-4
        low, second = sorted(loss)[:2]
        assert unsure[i] == (low > langid.FAR * np.log(2) * model.bit_weights.sum() or second - low < 0.05)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    texts = ["Ein langer Satz mit vielen Wörtern, 123 und Ödland. " * 5, "nur einwort", "x" * 100, "a b c d e f g", ". , "]
    whole = [langid._histograms([t]) for t in texts]
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(langid, "CHUNK_CHARS", size)
        for t, (v, n) in zip(texts, whole):
            got, m = langid._histograms([t])
            assert np.allclose(got, v, atol=1e-6) and m == n


def test_codewords():
    assert langid.codewords(4).shape == (4, 7)
    for k in (2, 3, 4, 5, 9):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert all(abs(col.sum()) < k for col in code.T)


def test_edge_rows(spark, edge_docs, no_docs):
    model = langid.fit(edge_docs)
    assert set(model.languages) <= {"en", "fr", "es", "de"}
    got = langid.predict(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        if r.doc_id in (4, 5, 6, 8):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.languages
    assert langid.predict(no_docs, model).count() == 0
    assert langid.fit(no_docs) is None
    assert {r.lang_pred for r in langid.predict(edge_docs, None).collect()} == {"und"}
    kept = langid.filter_documents(edge_docs)
    assert kept.columns == edge_docs.columns and not {4, 5, 6, 8} & {r.doc_id for r in kept.collect()}
    assert langid.filter_documents(no_docs).count() == 0


def test_one_language(spark, edge_docs):
    one = edge_docs.filter("lang = 'en'")
    got = langid.predict(one, langid.fit(one)).collect()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 7)} == {("en", 1.0)}
