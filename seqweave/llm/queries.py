"""The queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_ids, bpe, media, mixing, ngram_join, pii, quality, token_counts, toxicity, url_filter
from .common import table
from .sql import SQL

END_ID = 2


def byte_bpe() -> str:
    """The public tokenizer file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.train(toxicity.training_sample(docs, labels))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_sentences", F.to_json("toxic_sentences").alias("toxic_sentences"))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_hash_indexed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return binary_ids.export_and_read_back(docs, byte_bpe(), end_id=END_ID, vocabulary=50257)


def op4_weighted_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted_fair_queue(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source", "tie")


def op5_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"])


def op6_trie_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), byte_bpe(), keep=["doc_id"])
    return out.withColumn("scores", F.lit("zipf by id"))  # the vocabulary file has none of its own


def op7_minhash_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tie", "class_tie")


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_bands(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_noisy_or_toxicity": op1_noisy_or_toxicity,
    "op2_bootstrapped_pii": op2_bootstrapped_pii,
    "op3_hash_indexed_ids": op3_hash_indexed_ids,
    "op5_pair_index_bpe": op5_pair_index_bpe,
    "op4_weighted_fair_queue": op4_weighted_fair_queue,
    "op6_trie_unigram_counts": op6_trie_unigram_counts,
    "op7_minhash_jaccard": op7_minhash_jaccard,
    "op8_compression_bands": op8_compression_bands,
    "op9_link_graph_urls": op9_link_graph_urls,
    "op10_progressive_jpeg": op10_progressive_jpeg,
}

__all__ = ["QUERIES", "SQL"]
