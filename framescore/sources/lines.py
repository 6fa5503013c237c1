"""L1/S7/S8 on text: the place of a line in its input, without a sort or a window over lines.

Input order is the order of files by name (numbers in names compare as numbers), then of lines.
Spark reads a file in splits, and a task passes on the lines of a split in order, so the lines of one
split have ascending ids.  They are written once with file, split and id; the splits' first ids and
counts (a row a split) are summed up in input order, and a line's place is its id's distance from its
split's first id plus the lines of all splits before.  The table of splits is counted and broadcast
(above ``MAX_SHIFT_ROWS`` it is joined by a shuffle), so lines are never exchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescore.operators.offsets import MAX_SHIFT_ROWS
from framescore.session import materialize

POSITION = "pos"


def natural_key(path: Column) -> Column:
    """Sorts file names with their numbers as numbers."""
    parts = F.split(path, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 24, "0")).otherwise(x))


def _natural(path: str) -> list:
    return [x.zfill(24) if x.isdigit() else x for x in re.split(r"(?<=\D)(?=\d)|(?<=\d)(?=\D)", path)]


def _text(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(paths)


def line_positions(spark: SparkSession, paths) -> DataFrame:
    """``(pos, value)`` of every line below ``paths``, from 0 in input order."""
    lines = materialize(_text(spark, paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id")), "lines")
    splits = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(natural_key(F.col("_file")), "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(splits.select("_file", "_block", "_first",
                                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "line-splits")
    if splits.count() <= MAX_SHIFT_ROWS:
        splits = F.broadcast(splits)
    return lines.join(splits, ["_file", "_block"]).select(
        (F.col("_base") + F.col("_id") - F.col("_first")).alias(POSITION), "value")


def first_lines(spark: SparkSession, path, n: int) -> DataFrame:
    """L1: the first ``n`` lines in input order, ``(pos, value)``.  Files are taken in order, four times as
    many each time, until they hold ``n`` lines; later ones are only listed."""
    files = sorted(_text(spark, path).inputFiles(), key=_natural)
    taken = 1
    while taken < len(files) and _text(spark, files[:taken]).count() < n:
        taken *= 4
    if not files:
        return spark.createDataFrame([], "pos bigint, value string")
    return line_positions(spark, files[:taken]).where(F.col(POSITION) < int(n))


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """J1 without keys: rows of equal position side by side.  Both inputs have ``pos``; where one is shorter
    the other's rows stay, with nulls.  Only the columns given are exchanged, by position."""
    a = left.select(POSITION, F.struct(*[c for c in left.columns if c != POSITION]).alias("left"))
    b = right.select(POSITION, F.struct(*[c for c in right.columns if c != POSITION]).alias("right"))
    return a.join(b, POSITION, "full_outer")
