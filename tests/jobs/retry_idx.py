"""Run with task retries; fail the first attempt of partition 0 mid-way through
its rows (after some IDX files are already written); check the output."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pyarrow as pa  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from framescore.sources.idx import idx_images, idx_labels, write_idx_pair  # noqa: E402

spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fs-retry-ckpt-"))


@F.arrow_udf(T.BinaryType())
def flaky(v: pa.Array) -> pa.Array:
    ctx = TaskContext.get()
    if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
        flaky.seen = getattr(flaky, "seen", 0) + len(v)
        if flaky.seen > 35:
            raise RuntimeError("injected failure after some files were written")
    return v


df = spark.range(0, 100, numPartitions=2).select(
    F.col("id").alias("k"), flaky(F.unhex(F.lpad(F.hex(F.col("id") % 256), 8, "0"))).alias("px"),
    (F.col("id") % 10).cast("int").alias("y"))
out = tempfile.mkdtemp(prefix="fs-retry-idx-")
manifest = write_idx_pair(df, out, "px", "y", 2, 2, "k", rows_per_file=8)
assert manifest.agg(F.sum("n")).first()[0] == 100
j = idx_images(spark, out).join(idx_labels(spark, out), ["source", "pos"])
got = sorted((bytes(r["pixels"]), r["label"]) for r in j.collect())
want = sorted((bytes([0, 0, 0, i % 256]), i % 10) for i in range(100))
assert got == want, "IDX output differs after a task retry"
print("RETRY-OK")
