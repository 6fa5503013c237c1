"""Dense per-partition offsets (rank within a topic partition), at scale.

A window ``row_number() over (partition by p order by id)`` would put a whole
topic partition into one task; with few topic partitions that is one task per
third of the data.  Instead the rows are range-partitioned on ``(p, order)``
into many Spark partitions, numbered locally with
``monotonically_increasing_id`` after a local sort, and shifted by the row
counts of the earlier ranges of the same ``p``.  The shift table has at most
``#ranges + #topic-partitions`` rows.

The numbered rows are written once as a parquet table in the shared
checkpoint folder, so both uses read the same materialised ids even if an
executor is lost, and the shift aggregation reads only two narrow columns.  The number
of ranges follows the size of the input.  The shift table is counted and broadcast, so the
log is not shuffled a second time; only a table above ``MAX_SHIFT_ROWS`` (far more ranges and
topic partitions than a cluster has tasks) is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.session import ensure_checkpoint_dir, materialize


RANGE_BYTES = 64 << 20
MAX_SHIFT_ROWS = 1_000_000


def ranges_for(df: DataFrame) -> int:
    """One range per ``RANGE_BYTES`` of the plan's estimated size, a task per core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(-(-size // RANGE_BYTES), MAX_SHIFT_ROWS // 2))


def assign_offsets(df: DataFrame, partition_col: str, order_cols: list,
                   offset_col: str = "offset", num_ranges: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_ranges or ranges_for(df)
    keys = [partition_col, *order_cols]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_fs_rid", F.monotonically_increasing_id()))
    ranged = materialize(ranged, "offsets")
    ranged = ranged.withColumn("_fs_task", F.shiftright("_fs_rid", 33))
    shift = (ranged.groupBy(partition_col, "_fs_task")
                   .agg(F.min("_fs_rid").alias("_fs_first"), F.count(F.lit(1)).alias("_fs_n")))
    before = (Window.partitionBy(partition_col).orderBy("_fs_task")
              .rowsBetween(Window.unboundedPreceding, -1))
    shift = shift.select(partition_col, "_fs_task", "_fs_first",
                         F.coalesce(F.sum("_fs_n").over(before), F.lit(0)).alias("_fs_base"))
    # null-safe on the partition value, so rows without one are numbered too
    shift = shift.withColumnRenamed(partition_col, "_fs_p").withColumnRenamed("_fs_task", "_fs_t")
    shift = materialize(shift, "offset-shift")
    if shift.count() <= MAX_SHIFT_ROWS:
        shift = F.broadcast(shift)
    out = ranged.join(shift, F.col(partition_col).eqNullSafe(F.col("_fs_p"))
                      & (F.col("_fs_task") == F.col("_fs_t")))
    out = out.withColumn(offset_col,
                         (F.col("_fs_base") + F.col("_fs_rid") - F.col("_fs_first")).cast("bigint"))
    return out.drop("_fs_rid", "_fs_task", "_fs_first", "_fs_base", "_fs_p", "_fs_t")
