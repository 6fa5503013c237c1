"""The registered queries of the thirteen operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm import (bpe_words, hash_forest, hilbert, html_text, multi_index, ngram_join, packing, pii, quality_cnn,
                            quality_rules, turn_repair, url_filter, warc)
from framescore.llm.oracles import ORACLE_SQL  # noqa: F401 - read with the queries
from framescore.llm.tables import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(pii.find(table(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.contract(html_text.extract(pages, html_text.train(pages)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.digests(bpe_words.encode_decode(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.contract(quality_rules.apply_policy(
        quality_rules.ledger(table(spark, sf_dir, "documents"))))


def op10_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hash_forest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.hard_negatives(multi_index.quantised(table(spark, sf_dir, "embeddings")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.contract(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_url_filter, op3_quality_cnn, op4_hilbert_shards,
                                   op5_html_text, op6_ngram_join, op7_bpe_words, op8_packing, op9_quality_rules,
                                   op10_hash_forest, op11_warc, op12_multi_index, op13_turn_repair)}
