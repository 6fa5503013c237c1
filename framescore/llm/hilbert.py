"""Operator 4: shards as runs of a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its own quantiles, so a value that holds a third of
all rows spans cells instead of filling one.  Rows are ordered by (curve index,
text hash, id, reading order) with one range exchange over small rows (the text
itself never moves), and the order is cut into ``n_shards`` runs whose row counts
differ by one at most (law ``rows``).  Neighbours on the curve are neighbours in
every dimension, so a run covers a compact box and a filter on any dimension skips
files (``pruning_boxes``).  Text dimensions are cut by whole values, however long their
common beginning.  Copies that agree in their metadata are neighbours;
a group may be cut at a run's edge, as the law demands when a group is larger
than a shard.

The range exchange deals by the whole order, the reading position included, so no
key, hot source or group of copies lands in one task.  The driver sees quantiles
and one row count per range partition.

Defined cases: a null text has size 8 and a null hash; null metadata and null ids
come first; repeated rows are rows of their own; fewer rows than shards leave the
last shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.llm.tables import column_or_null, shuffle_width, stored

BITS = 4
ROW_OVERHEAD = 8
#: Error of the quantiles of a dimension: 1 / this.
QUANTILE_ACCURACY = 1000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (n, dims) with ``bits`` bits per axis.

    The axes are brought into the curve's transposed form from the highest bit
    down: where an axis has the bit, the lower bits of the first axis are inverted,
    else they are exchanged with the axis's own; then the Gray code is undone.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            has = (x[i] >> b) & 1 == 1
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _curve(dims: int, bits: int):
    @F.pandas_udf(T.LongType())
    def run(*codes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in codes], axis=1), bits))
    return run


def _is_text(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType))


def ordinal(df: DataFrame, name: str) -> Column:
    """The column in its own order: numbers and times as doubles, all else as whole text."""
    kind = df.schema[name].dataType
    if _is_text(kind):
        return F.col(name).cast("string")
    return F.col(name).cast("timestamp" if not isinstance(kind, T.NumericType) else kind).cast("double")


def text_quantiles(keyed: DataFrame, dims: list[str], cuts: int) -> dict[str, list[str]]:
    """For each text dimension its ``cuts`` - 1 quantiles by row, exact, whole values.

    Values are counted, the distinct ones are put in order by ranges, and the row counts
    of the ranges before give each value its place among all rows.  The driver sees a
    count per range and the quantiles."""
    if not dims:
        return {}
    spark = keyed.sparkSession
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])).alias("p")
    values = (keyed.select(pairs).select("p.*").filter("value IS NOT NULL").groupBy("dim", "value")
              .agg(F.count("*").alias("n")))
    ranged = stored(values.repartitionByRange(shuffle_width(spark), "dim", "value")
                    .withColumn("_range", F.spark_partition_id()), "hilbert-values")
    totals = sorted((r["dim"], r["_range"], r["n"]) for r in
                    ranged.groupBy("dim", "_range").agg(F.sum("n").alias("n")).collect())
    starts, rows = [], {}
    for d, r, n in totals:
        starts.append((d, r, rows.get(d, 0)))
        rows[d] = rows.get(d, 0) + n
    if not rows:
        return {d: [] for d in dims}
    before = spark.createDataFrame(starts, "dim string, _range int, _start bigint")
    whole = spark.createDataFrame(list(rows.items()), "dim string, _rows bigint")
    own = Window.partitionBy("dim", "_range").orderBy("value")
    placed = (ranged.join(F.broadcast(before), ["dim", "_range"]).join(F.broadcast(whole), "dim")   # a row a range
              .withColumn("_end", F.col("_start") + F.sum("n").over(own)))
    at = F.expr(f"filter(sequence(1, {cuts - 1}), k -> ceil(k * _rows / {cuts}) > _end - n "
                f"AND ceil(k * _rows / {cuts}) <= _end)")
    found = placed.select("dim", "value", F.explode(at).alias("k")).collect()      # cuts - 1 a dimension
    return {d: [r["value"] for r in sorted(found, key=lambda r: r["k"]) if r["dim"] == d] for d in dims}


def order_on_curve(keyed: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``curve``: each dimension cut at its quantiles into 2**bits codes.

    A value's code is the middle of the quantiles that it spans, so few frequent values
    lie apart on the whole axis and reach its high bits; a null has code 0."""
    cuts = 1 << bits
    texts = [d for d in dims if _is_text(keyed.schema[d].dataType)]
    numbers = [d for d in dims if d not in texts]
    quantiles = text_quantiles(keyed, texts, cuts)
    if numbers:
        quantiles |= keyed.agg(*[F.percentile_approx(d, [k / cuts for k in range(1, cuts)],
                                                     QUANTILE_ACCURACY).alias(d) for d in numbers]).first().asDict()
    codes = []
    for d in dims:
        twice = F.lit(0)
        for q in quantiles[d] or []:
            twice = twice + (F.col(d) > F.lit(q)).cast("int") + (F.col(d) >= F.lit(q)).cast("int")
        codes.append(F.coalesce(F.floor(twice / 2).cast("int"), F.lit(0)))
    return keyed.withColumn("curve", _curve(len(dims), bits)(*codes))


def global_positions(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """(df with ``position``, its gapless place in the order; number of rows)."""
    width = shuffle_width(df.sparkSession)
    ranged = (df.repartitionByRange(width, *order).sortWithinPartitions(*order)
              .withColumn("_range", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ranged = stored(ranged, name)
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame(
        [(k, s) for (k, _), s in zip(counts, starts, strict=False)], "_range int, _start bigint")
    placed = (ranged.join(F.broadcast(offsets), "_range")          # one row per range partition
              .withColumn("position", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start"))
    return placed, starts[-1]


def hilbert_shards(docs: DataFrame, n_shards: int = 24, dims: tuple[str, ...] = ("lang", "source"),
                   id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the
    dimensions' values ``dim_0``... (see ``ordinal``); the text's size is always the last dimension."""
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")
    known = [d for d in dims if d in docs.columns]
    names = [f"dim_{k}" for k in range(len(known) + 1)]
    keyed = docs.select(column_or_null(docs, id_col, "bigint").alias("doc_id"), size.alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"),
                        *[ordinal(docs, d).alias(n) for d, n in zip(known, names, strict=False)],
                        size.cast("double").alias(names[-1]),
                        F.monotonically_increasing_id().alias("_row"))
    curved = order_on_curve(stored(keyed, "hilbert-keys"), names, bits)
    placed, n = global_positions(curved, ["curve", "text_crc32", "doc_id", "_row"], "hilbert-order")
    base, more = divmod(n, n_shards)
    wide = more * (base + 1)                       # rows in the shards that hold one row more
    pos = F.col("position")
    in_wide = pos < wide
    shard = F.when(in_wide, F.floor(pos / (base + 1))).otherwise(
        more + F.floor((pos - wide) / max(base, 1)))
    slot = F.when(in_wide, pos % (base + 1)).otherwise((pos - wide) % max(base, 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                         shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "curve", *names)


def pruning_boxes(shards: DataFrame) -> DataFrame:
    """Per shard the least and largest value of each dimension: what a reader prunes by."""
    names = [c for c in shards.columns if c.startswith("dim_")]
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"),
                                       *[F.min(c).alias(f"min_{c}") for c in names],
                                       *[F.max(c).alias(f"max_{c}") for c in names])


def write_shards(shards: DataFrame, path: str) -> None:
    """Files by shard, in slot order, so that footers carry the boxes."""
    (shards.repartitionByRange(shuffle_width(shards.sparkSession), "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
