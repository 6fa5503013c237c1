"""S7/S8 + P3: feature CSV scan.

Rows are comma-separated floats without a header; the first ``width`` fields
are the features and any extra columns are ignored.  The text is read with
``spark.read.text`` (splittable, no schema inference over hundreds of
columns) and parsed with Catalyst expressions.

Rejects: fewer than ``width`` fields (``short_row``), or a field that is empty
or not a number (``bad_number``).  Field text is parsed like the JVM's float
parser (surrounding blanks, ``NaN``, ``Infinity`` accepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features"
REASON = "reject_reason"


def split_fields(line) -> Column:
    v = F.col(line) if isinstance(line, str) else line
    return F.split(v, ",")


def parse_features(df: DataFrame, width: int, line: str = "value",
                   out: str = FEATURES, keep_fields: bool = False) -> DataFrame:
    """Add ``out`` ARRAY<FLOAT> (first ``width`` fields) and ``reject_reason``."""
    fields = split_fields(line)
    head = F.slice(fields, 1, width)
    parsed = head.try_cast("array<float>")          # element-wise: a bad field becomes null
    n_bad = F.size(F.filter(parsed, lambda x: x.isNull()))
    reason = (F.when(F.col(line).isNull(), F.lit("null_row"))
              .when(F.size(fields) < width, F.lit("short_row"))
              .when(n_bad > 0, F.lit("bad_number")))
    out_df = df.withColumn("_fs_fields", fields) if keep_fields else df
    return (out_df.withColumn(REASON, reason)
                  .withColumn(out, F.when(F.col(REASON).isNull(), parsed)))


def feature_csv(spark: SparkSession, path: str, width: int = 500,
                keep_fields: bool = False) -> DataFrame:
    """Read feature CSV text files into ``(value, features, reject_reason)``."""
    lines = spark.read.text(path)
    return parse_features(lines, width, keep_fields=keep_fields)


def render_csv_line(features, *extra) -> Column:
    """Features (+ trailing extra columns) as one CSV line, floats in JVM text.

    A null element or extra column is an empty field, so it keeps its place (and
    an empty feature field is then a ``bad_number``); null features have no line."""
    f = F.col(features) if isinstance(features, str) else features
    parts = [F.array_join(f.cast("array<string>"), ",", "")]
    for e in extra:
        parts.append(F.lit(","))
        parts.append(F.coalesce((F.col(e) if isinstance(e, str) else e).cast("string"), F.lit("")))
    return F.concat(*parts)
