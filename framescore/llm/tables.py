"""Shared table handling of this subpackage: reading, shared folders, partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives
    lost executors, and lets later readers load only the columns they use."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}")                 # ``session.drop_derived`` removes it
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of the ``stored`` tables that ``df`` reads and nothing else needs."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def column_or_null(df: DataFrame, name: str, kind: str):
    """Column ``name`` cast to ``kind``, or a null of that type where it is missing."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
