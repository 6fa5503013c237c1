"""Model scoring on the executors, one Arrow batch at a time.

``score`` is one Arrow UDF in a projection: the model is shipped once as a file, each
Arrow batch of the feature column becomes one [n, d] matrix (no per-row
Python), the model runs on the whole matrix, and the winning class follows the
P8 rule.  Only the feature column is sent to the Python worker; the other
columns stay in the JVM.  No shuffle; the same function runs on batch and
streaming DataFrames.

Input forms (``input=``):
  * ``"floats"``  - ARRAY<FLOAT> column
  * ``"f32be"``   - big-endian float32 payload (decoded inside the same pass,
                     so the batch crosses JVM -> Python once)
  * ``("u8", divisor)`` - unsigned-byte payload divided by ``divisor``

Rows whose width is not the model's get null scores and a null label (split
them off with ``operators.rejects`` first to keep a reason).

U1 lifecycle: a model that has ``open()`` is opened once per task, and what that returns (a session
with ``predict``) does the scoring; if it has ``close()``, it is closed when the task ends, also on
failure.  The model file itself is loaded once per Python worker.

Stage times (P12) are measured per Arrow batch and apportioned per row
(``batch ns / rows``); ``batch_rows`` says how many rows shared the batch.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.argmax import winning_class
from framescore.functions.codec import (FLOAT_BYTES, WIRE_DTYPE, _binary_parts, _gather)
from framescore.operators.models import load_model, ship_model

SCORE_FIELDS = [
    T.StructField("scores", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    T.StructField("prob", T.DoubleType()),
]
TIMING_FIELDS = [
    T.StructField("start_ms", T.LongType()),
    T.StructField("tensor_ns", T.LongType()),
    T.StructField("infer_ns", T.LongType()),
    T.StructField("post_ns", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("batch_rows", T.IntegerType()),
]


def _matrix_from_list(arr, d: int):
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    n = len(arr)
    lengths = pc.list_value_length(arr).fill_null(-1).to_numpy(zero_copy_only=False)
    ok = lengths == d
    if ok.all():                                   # common case: no scatter, no zero fill
        flat = pc.list_flatten(arr).cast(pa.float32()).to_numpy(zero_copy_only=False)
        return flat.reshape(n, d), ok
    x = np.zeros((n, d), dtype=np.float32)
    if ok.any():
        sub = arr.filter(pa.array(ok))
        flat = pc.list_flatten(sub).cast(pa.float32()).to_numpy(zero_copy_only=False)
        x[ok] = flat.reshape(-1, d)
    return x, ok


def _matrix_from_payload(arr, d: int, kind):
    starts, lengths, data, valid = _binary_parts(arr)
    n = len(lengths)
    if kind == "f32be":
        ok = valid & (lengths // FLOAT_BYTES == d)
        raw = _gather(starts, np.where(ok, d * FLOAT_BYTES, 0), data)
        vals = np.frombuffer(np.ascontiguousarray(raw), dtype=WIRE_DTYPE).astype(np.float32)
    else:
        _, divisor = kind
        ok = valid & (lengths == d)
        raw = _gather(starts, np.where(ok, d, 0), data)
        vals = raw.astype(np.float32)
        vals /= np.float32(divisor)
    if ok.all():                                   # common case: the decoded block is the matrix
        return vals.reshape(n, d), ok
    x = np.zeros((n, d), dtype=np.float32)
    x[ok] = vals.reshape(-1, d)
    return x, ok


def _fields(timings: bool, with_scores: bool) -> list[T.StructField]:
    return (SCORE_FIELDS if with_scores else SCORE_FIELDS[1:]) + (TIMING_FIELDS if timings else [])


_ARROW_TYPES = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64()}


def _arrow_field(f: T.StructField) -> pa.Field:
    if isinstance(f.dataType, T.ArrayType):
        return pa.field(f.name, pa.list_(pa.float32()))
    return pa.field(f.name, _ARROW_TYPES[type(f.dataType)])


def score_column(model, features, input="floats", timings: bool = True,
                 with_scores: bool = True, spark=None) -> Column:
    """The scorer as one Arrow UDF over the feature column, returning a struct
    ``(scores, label, prob[, start_ms, tensor_ns, infer_ns, post_ns, end_ms,
    batch_rows])``.  Only the feature column crosses to Python; every other
    column of the row stays in the JVM."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    shipped = ship_model(spark, model)
    d = int(model.width)
    fields = _fields(timings, with_scores)
    out_type = T.StructType(fields)
    arrow_fields = [_arrow_field(f) for f in fields]

    def scored(m, col: pa.Array) -> pa.Array:
        n = len(col)
        start_ms = time.time_ns() // 1_000_000
        t0 = time.perf_counter_ns()
        if input == "floats":
            x, ok = _matrix_from_list(col, d)
        else:
            x, ok = _matrix_from_payload(col, d, input)
        t1 = time.perf_counter_ns()
        s = m.predict(x) if n else np.zeros((0, getattr(m, "classes", 0)))
        t2 = time.perf_counter_ns()
        s = np.asarray(s)
        lab = winning_class(s)
        k = s.shape[1] if s.ndim == 2 else 0
        prob = s[np.arange(n), lab] if k else np.full(n, np.nan)
        if getattr(m, "labels", None) is not None and k:
            lab = m.labels[lab]
        bad = ~ok
        cols = []
        if with_scores:
            offs = pa.array(np.arange(n + 1, dtype=np.int32) * k, type=pa.int32())
            cols.append(pa.ListArray.from_arrays(
                offs, pa.array(np.asarray(s, dtype=np.float32).reshape(-1)),
                mask=pa.array(bad)))
        cols += [pa.array(lab.astype(np.int32), mask=bad),
                 pa.array(prob.astype(np.float64), mask=bad)]
        if timings:
            t3 = time.perf_counter_ns()
            end_ms = time.time_ns() // 1_000_000
            per = max(n, 1)
            cols += [pa.array(np.full(n, start_ms, dtype=np.int64)),
                     pa.array(np.full(n, (t1 - t0) // per, dtype=np.int64)),
                     pa.array(np.full(n, (t2 - t1) // per, dtype=np.int64)),
                     pa.array(np.full(n, (t3 - t2) // per, dtype=np.int64)),
                     pa.array(np.full(n, end_ms, dtype=np.int64)),
                     pa.array(np.full(n, n, dtype=np.int32))]
        return pa.StructArray.from_arrays(cols, fields=arrow_fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = load_model(shipped)
        session = m.open() if hasattr(m, "open") else m
        try:
            for col in batches:
                yield scored(session, col)
        finally:                                    # also where the task fails or is cancelled
            if hasattr(session, "close"):
                session.close()

    udf = F.arrow_udf(run, out_type)
    if timings:
        udf = udf.asNondeterministic()      # reads clocks: never evaluate twice
    c = F.col(features) if isinstance(features, str) else features
    return udf(c)


def score(df: DataFrame, model, features: str = "features", keep: list | None = None,
          input="floats", timings: bool = True, with_scores: bool = True) -> DataFrame:
    """Score ``features`` with ``model``; output = ``keep`` columns (default: all
    but the features) + scores (unless ``with_scores=False``), label, prob (+ stage times)."""
    keep = [c for c in df.columns if c != features] if keep is None else list(keep)
    s = score_column(model, features, input, timings, with_scores, spark=df.sparkSession)
    names = [f.name for f in _fields(timings, with_scores)]
    staged = df.select(*keep, s.alias("_fs_score"))
    return staged.select(*keep, *[F.col("_fs_score")[n].alias(n) for n in names])
