"""Corpus pipeline: documents through five of the numbered operators.

Each stage works on all its predecessor kept: texts that the quality classifier rejects go,
then those that the quality rules reject; of each group of near duplicates one document stays;
personal data is replaced by its kind in brackets; the rest is packed into token sequences.
All stages but the last return the columns of ``documents``; null ids and null texts pass
through the operators as those define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm import ngram_join, packing, pii, quality_cnn, quality_rules
from framescore.llm.queries import tokenizer_path
from framescore.llm.tables import stored, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 3), trained on these documents, accepts."""
    return quality_cnn.keep(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules' policy (operator 9)."""
    return quality_rules.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (operator 6)."""
    return ngram_join.representatives(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data (operator 1); ``n_chars`` follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences (operator 8)."""
    return packing.digests(packing.pack(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("quality_classifier", classified), ("quality_rules", ruled), ("ngram_jaccard_join", distinct),
          ("pii", redacted), ("packing", packed)]

#: The stages hold trained models and token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
