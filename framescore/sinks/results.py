"""K1-K5: result sinks and bounded read-back.

* K1 string result stream -> broker topic ``<topic>-return`` (or file replay)
* K2 text output with overwrite: batch ``write.mode("overwrite").text``;
  streaming uses ``foreachBatch`` into ``path/batch_id=N`` with overwrite,
  so a retried micro-batch replaces its own output (idempotent)
* K3 keyed binary records (``acks=all``) or a parquet record log
* K4 predictions as a table, never printed on the driver
* K5 bounded, ordered read-back of a result output
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.operators.limits import first_n
from framescore.sources.records import KAFKA_HINT, RECORD_SCHEMA


def kafka_sink_options(topic: str, bootstrap: str, acks: str = "all",
                       checkpoint: str | None = None) -> dict:
    opts = {"kafka.bootstrap.servers": bootstrap, "topic": topic, "kafka.acks": acks}
    if checkpoint:
        opts["checkpointLocation"] = checkpoint
    return opts


def write_text(df: DataFrame, path: str, col: str = "value") -> None:
    """K2 batch form: one text line per row, output replaced."""
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_record_log(df: DataFrame, path: str, partition_by_topic: bool = False,
                     max_records_per_file: int | None = None) -> None:
    """K3 replay form: records with the broker's schema as parquet.  Files are
    split by ``max_records_per_file`` inside each task (no shuffle)."""
    w = df.select(*[F.col(f.name).cast(f.dataType) for f in RECORD_SCHEMA.fields]).write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(int(max_records_per_file)))
    if partition_by_topic:
        w = w.partitionBy("topic")
    w.parquet(path)


def publish_kafka(df: DataFrame, topic: str, bootstrap: str) -> None:
    """K3 broker form (needs the Kafka connector on the classpath)."""
    try:
        (df.select("key", "value").write.format("kafka")
           .options(**kafka_sink_options(topic, bootstrap)).save())
    except Exception as e:  # noqa: BLE001 - re-raised with the fix
        if "Failed to find data source" in str(e):
            raise RuntimeError(KAFKA_HINT.format(version=df.sparkSession.version)) from e
        raise


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K4: predictions written as a table."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet", limit: int | None = None,
                 order_by=("offset", "partition")) -> DataFrame:
    """K5: read a result output back, first ``limit`` rows in record order."""
    df = spark.read.format(fmt).load(path)
    return df if limit is None else first_n(df, limit, list(order_by))


def return_topic_reader_options(topic: str, bootstrap: str) -> dict:
    """K5 broker form: batch read of ``<topic>-return`` from the earliest offset."""
    from framescore.functions.trace import return_topic_name
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": return_topic_name(topic),
            "startingOffsets": "earliest", "endingOffsets": "latest"}


def read_return_topic(spark: SparkSession, topic: str, bootstrap: str,
                      limit: int | None = None) -> DataFrame:
    """K5: result lines with the broker's timestamp (what a console consumer with
    ``print.timestamp`` captures), first ``limit`` in (offset, partition) order."""
    df = (spark.read.format("kafka").options(**return_topic_reader_options(topic, bootstrap))
          .load().select("partition", "offset", "timestamp",
                         F.col("value").cast("string").alias("value")))
    return df if limit is None else first_n(df, limit, ["offset", "partition"])
