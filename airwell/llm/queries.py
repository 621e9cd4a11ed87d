"""Registered queries of the operators and of the pipeline.

Each callable takes (spark, sf_dir), reads its whole table and returns the
operator's full result in the digest columns of the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from airwell.llm import (align, bin_slack, bpe, embed_dedup, hard_negatives, html_text, langid, minhash, packing, pii,
                         quality, sharding, token_orc)
from airwell.llm._common import read_table

# production parameters: the public tokenizer files, read on the workers
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies; the same on every machine that has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with equal labels at cosine 0.98."""
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


@_query
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@_query
def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in ORC files, read back and digested."""
    return token_orc.digests(spark, token_orc.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)))


@_query
def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document as span lists and a digest of the base kinds."""
    t = pii.spans(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return t.select(
        "doc_id", *[count(kind) for kind in pii.BASE],
        F.sha2(pii.span_list("spans", pii.BASE), 256).alias("base_sha256"), pii.span_list("spans").alias("spans"))


@_query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents at Jaccard 0.85."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=0.85)


@_query
def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model is fitted on the rows outside the held-out part."""
    docs = read_table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the automaton, as digests."""
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


@_query
def op8_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.shard(read_table(spark, sf_dir, "documents"), "doc_id")


@_query
def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, divergences and verdict per document."""
    return quality.score(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_jsd", 6).alias("char_jsd"), F.round("word_jsd", 6).alias("word_jsd"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


@_query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, cut into groups at their common ends."""
    return align.align(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh one are moved on first."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


@_query
def op13_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into full sequences of 2048 tokens."""
    return bin_slack.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from airwell.llm import oracle
    return dict(oracle.ORACLE_SQL)
