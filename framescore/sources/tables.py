"""Record logs derived from the warehouse tables.

The keypoint CSV, broker topics and image files of the original workload are
not available, so the given tables stand in for them (rules in FIXTURES.md):

* ``embeddings`` -> keypoint feature records: key = text of
  ``1700000000000 + vec_id``, value = big-endian float32 payload,
  partition = ``vec_id % 4``, offset = ``vec_id div 4``.
* ``events`` -> timed records: key = epoch-millis text of ``ts``, value = the
  float32 payload of ``value``, partition = ``user_id % 4``, offset = rank of
  ``event_id`` within the partition (computed with ``assign_offsets``).
* ``documents`` -> raw byte records: value = UTF-8 bytes of ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.codec import encode_features, epoch_millis
from framescore.operators.offsets import assign_offsets
from framescore.sources.records import DEFAULT_TOPIC

# Fixed values of the stand-in record logs.
KEY_BASE_MS = 1700000000000
N_TOPIC_PARTITIONS = 4
TOPIC = DEFAULT_TOPIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_records(spark: SparkSession, sf_dir: str, topic: str = TOPIC) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    ms = F.lit(KEY_BASE_MS) + F.col("vec_id")
    return e.select(
        ms.cast("string").cast("binary").alias("key"),
        encode_features("embedding").alias("value"),
        F.lit(topic).alias("topic"),
        (F.col("vec_id") % N_TOPIC_PARTITIONS).cast("int").alias("partition"),
        F.expr(f"vec_id div {N_TOPIC_PARTITIONS}").cast("bigint").alias("offset"),
        F.timestamp_millis(ms).alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def event_records(spark: SparkSession, sf_dir: str, topic: str = "events") -> DataFrame:
    """Offsets are assigned on the narrow columns first; the key text and the
    float32 payload are built afterwards, so neither the range sampling nor the
    shuffle runs the encoder or moves payload bytes."""
    src = table(spark, sf_dir, "events")
    ntz = isinstance(src.schema["ts"].dataType, T.TimestampNTZType)
    narrow = src.select("event_id", epoch_millis("ts", ntz).alias("_fs_ms"), "value",
                        (F.col("user_id") % N_TOPIC_PARTITIONS).cast("int").alias("partition"))
    numbered = assign_offsets(narrow, "partition", ["event_id"])
    return numbered.select(
        "event_id",
        F.col("_fs_ms").cast("string").cast("binary").alias("key"),
        encode_features(F.array(F.col("value").cast("float"))).alias("value"),
        F.lit(topic).alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis("_fs_ms").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def document_records(spark: SparkSession, sf_dir: str, topic: str = "documents") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("doc_id").cast("string").cast("binary").alias("key"),
        F.encode(F.col("text"), "UTF-8").alias("value"),
        F.lit(topic).alias("topic"),
        (F.col("doc_id") % N_TOPIC_PARTITIONS).cast("int").alias("partition"),
        F.expr(f"doc_id div {N_TOPIC_PARTITIONS}").cast("bigint").alias("offset"),
        F.timestamp_millis(F.lit(KEY_BASE_MS) + F.col("doc_id")).alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
