"""One commit per micro-batch for everything that it writes.

A micro-batch of the launcher writes result lines and rejects.  Its manifest, a JSON file
``<batch>.json`` in the commits folder, is written last and in one step; it names the folders and
holds the batch's counts, observed in the same pass (A1, §1.3): records, lines, rejects by reason,
and measures of the job's output.  ``committed_lines`` and ``committed_rejects`` read only what
manifests name, so a batch that dies between its two writes shows neither; its retry writes both
anew, and a batch that has its manifest is not written again.  ``batches`` reads the counts.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.session import _filesystem, read_bytes, write_bytes

REJECT_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("reject_reason", T.StringType())])
BATCH_SCHEMA = "batch bigint, records bigint, lines bigint, rejects map<string, bigint>, measures map<string, double>"


def _manifest(commits: str, batch: int) -> str:
    return f"{commits.rstrip('/')}/{batch}.json"


def is_committed(commits: str, batch: int) -> bool:
    fs, path = _filesystem(_manifest(commits, batch))
    return fs.get_file_info(path).type == pafs.FileType.File


def commit(commits: str, batch: int, **content) -> None:
    write_bytes(_manifest(commits, batch), json.dumps({"batch": batch, **content}).encode())


def manifests(commits: str) -> list[dict]:
    """In batch order; a few hundred bytes a micro-batch."""
    fs, folder = _filesystem(commits)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".json")]
    return sorted((json.loads(read_bytes(f"{commits.rstrip('/')}/{p.rsplit('/', 1)[1]}")) for p in names),
                  key=lambda m: m["batch"])


def committed_lines(spark: SparkSession, commits: str) -> DataFrame:
    """``value`` and ``batch_id`` of the committed result lines."""
    folders = [m["lines_path"] for m in manifests(commits) if m.get("lines_path")]
    if not folders:
        return spark.createDataFrame([], "value string, batch_id bigint")
    return spark.read.text(folders).withColumn(
        "batch_id", F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)/", 1).cast("bigint"))


def committed_rejects(spark: SparkSession, commits: str) -> DataFrame:
    """The committed rejects, with key, value and reason; none are an empty table."""
    folders = [m["rejects_path"] for m in manifests(commits) if m.get("rejects_path")]
    if not folders:
        return spark.createDataFrame([], REJECT_SCHEMA)
    return spark.read.schema(REJECT_SCHEMA).parquet(*folders)


def batches(spark: SparkSession, commits: str) -> DataFrame:
    """A row per committed micro-batch: its observed counts and measures."""
    rows = [(m["batch"], m["records"], m["lines"], m["rejects"], m["measures"]) for m in manifests(commits)]
    return spark.createDataFrame(rows, BATCH_SCHEMA)
