"""J1 + A1: align predictions with labels and measure accuracy.

The alignment is an equi-join on the record key (the row position of the
original arrays becomes an explicit key column); Catalyst/AQE chooses a
broadcast or sort-merge join from the runtime sizes.  The counts are a global
aggregate with map-side partial aggregation, so only one row per task
crosses the shuffle.  Accuracy divides by the real row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(pred: DataFrame, labels: DataFrame, on, pred_col: str = "label",
          truth_col: str = "label") -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    p = pred.select(*on, F.col(pred_col).alias("pred"))
    t = labels.select(*on, F.col(truth_col).alias("truth"))
    return p.join(t, on, "inner")


def accuracy(pred: DataFrame, labels: DataFrame, on, pred_col: str = "label",
             truth_col: str = "label") -> DataFrame:
    """``(n, n_correct, accuracy)`` over the key-aligned rows."""
    j = align(pred, labels, on, pred_col, truth_col)
    return accuracy_of(j, "pred", "truth")


def accuracy_of(df: DataFrame, pred_col: str, truth_col: str) -> DataFrame:
    hit = F.when(F.col(pred_col).cast("int") == F.col(truth_col).cast("int"), 1).otherwise(0)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("n_correct"))
    return agg.select("n", F.coalesce("n_correct", F.lit(0)).cast("bigint").alias("n_correct"),
                      (F.col("n_correct") / F.col("n")).cast("double").alias("accuracy"))


def positional_accuracy(zipped: DataFrame, pred: str = "left.label", truth: str = "right.label") -> DataFrame:
    """``(n, n_correct, accuracy, only_left, only_right)`` of rows zipped by position: pairs count, and rows of
    the longer input are reported, not dropped.  A pair without a prediction counts as wrong."""
    pair = F.col("left").isNotNull() & F.col("right").isNotNull()
    hit = F.when(pair & (F.col(pred).cast("int") == F.col(truth).cast("int")), 1)
    agg = zipped.agg(F.count(F.when(pair, 1)).alias("n"), F.count(hit).alias("n_correct"),
                     F.count(F.when(F.col("right").isNull(), 1)).alias("only_left"),
                     F.count(F.when(F.col("left").isNull(), 1)).alias("only_right"))
    return agg.select("n", "n_correct", (F.col("n_correct") / F.nullif("n", F.lit(0))).cast("double").alias("accuracy"),
                      "only_left", "only_right")
