"""Keyed record streams with partition and offset.

One function serves the live broker (``format("kafka")``) and a replayable
parquet record log with the same schema.  The column projections of the four
reference decoders (meta, key/value, value-only, text) are plain selects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.codec import send_time
from framescore.sources.record_log import read_log

# Spark's Kafka source schema; the parquet record log uses the same columns.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
])

# Fixed value: the default topic name of the original jobs.
DEFAULT_TOPIC = "stair"

KAFKA_HINT = ("the Kafka connector is not on the classpath; start Spark with "
              "--packages org.apache.spark:spark-sql-kafka-0-10_2.13:{version} "
              "or replay a parquet record log with source='parquet'")

# Column projections of the reference decoders.
PROJECTIONS = {
    "meta": ("partition", "offset", "key", "value"),    # S1
    "keyvalue": ("key", "value"),                       # S2
    "value": ("value",),                                # S3
}


def kafka_options(topic: str, bootstrap: str, starting_offsets: str | None = None,
                  group_id: str | None = None, max_offsets_per_trigger: int | None = None,
                  min_partitions: int | None = None, extra: dict | None = None) -> dict:
    """Reader options for a broker topic.

    S6: the consumer group is named after the topic.  S5: ``earliest`` start is
    an option; without it a first run starts at ``latest`` and later runs
    resume from the query checkpoint.  ``min_partitions`` lets Spark cut one
    hot topic partition into several offset ranges read by separate tasks;
    ``max_offsets_per_trigger`` bounds a micro-batch.
    """
    opts = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "kafka.group.id": group_id or topic,
    }
    if starting_offsets:
        opts["startingOffsets"] = starting_offsets
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    if min_partitions:
        opts["minPartitions"] = str(int(min_partitions))
    opts.update(extra or {})
    return opts


def record_stream(spark: SparkSession, source: str = "parquet", *, path: str | None = None,
                  topic: str | None = None, bootstrap: str | None = None,
                  starting_offsets=None, projection: str = "meta",
                  streaming: bool = True, max_files_per_trigger: int | None = None,
                  max_offsets_per_trigger: int | None = None,
                  min_partitions: int | None = None,
                  max_bytes_per_trigger: int | None = None, ending_offsets=None,
                  group: str | None = None, progress: str | None = None) -> DataFrame:
    """Open a record source and project the decoder's columns.  ``log`` is a committed record
    log read by offsets (``record_log``); offsets, group and progress are options of that."""
    reader = spark.readStream if streaming else spark.read
    if source == "kafka":
        try:
            df = reader.format("kafka").options(**kafka_options(
                topic, bootstrap, starting_offsets, max_offsets_per_trigger=max_offsets_per_trigger,
                min_partitions=min_partitions)).load()
        except Exception as e:  # noqa: BLE001 - re-raised with the fix
            if "Failed to find data source" in str(e):
                raise RuntimeError(KAFKA_HINT.format(version=spark.version)) from e
            raise
    elif source == "log":
        df = read_log(spark, path, streaming, starting_offsets=starting_offsets, ending_offsets=ending_offsets,
                      group=group, progress=progress, max_offsets_per_trigger=max_offsets_per_trigger,
                      min_partitions=min_partitions)
        if topic is not None:
            df = df.where(F.col("topic") == F.lit(topic))
    else:
        r = reader.schema(RECORD_SCHEMA).format(source)
        if streaming and max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(int(max_files_per_trigger)))
        if streaming and max_bytes_per_trigger:      # size-bounded micro-batches
            r = r.option("maxBytesPerTrigger", str(int(max_bytes_per_trigger)))
        df = r.load(path)
        if topic is not None:
            df = df.where(F.col("topic") == F.lit(topic))
    if projection == "text":                             # S4: bad bytes are replaced as in P7
        return df.select(send_time("value").alias("value"))
    if projection == "all":
        return df
    return df.select(*PROJECTIONS[projection])


def from_offsets(df: DataFrame, start) -> DataFrame:
    """S5 replay form: keep records at or after a start offset.

    ``start`` is one offset for every partition or a ``{partition: offset}``
    mapping (partitions not named start at 0).  The predicate reaches the
    parquet scan as a pushed filter.
    """
    if isinstance(start, dict):
        cond = None
        for p, o in start.items():
            c = (F.col("partition") == int(p)) & (F.col("offset") >= int(o))
            cond = c if cond is None else cond | c
        # partitions not named (a null partition included) start at offset 0
        rest = F.coalesce(~F.col("partition").isin([int(p) for p in start]), F.lit(True))
        return df.where(F.coalesce(cond, F.lit(False)) | rest)
    return df.where(F.col("offset") >= int(start))


def publish_records(df: DataFrame, key: str, value: str, topic: str,
                    partition: str | None = None, offset: str | None = None,
                    timestamp: str | None = None) -> DataFrame:
    """K3 record shape: (key, value) plus the broker-side columns when replaying."""
    cols = [F.col(key).cast("binary").alias("key"), F.col(value).alias("value"),
            F.lit(topic).alias("topic")]
    cols.append((F.col(partition) if partition else F.lit(None)).cast("int").alias("partition"))
    cols.append((F.col(offset) if offset else F.lit(None)).cast("bigint").alias("offset"))
    cols.append((F.col(timestamp) if timestamp else F.current_timestamp())
                .cast("timestamp").alias("timestamp"))
    cols.append(F.lit(0).alias("timestampType"))
    return df.select(*cols)
