"""Record payload codecs (column expressions).

Payloads are float32 vectors written big-endian, 4 bytes per element; a length
that is not a multiple of 4 keeps ``floor(len/4)`` elements and drops the tail.

Whole-vector work (encode, decode, byte scaling) runs as Arrow UDFs: the
binary/list child buffers are handled once per Arrow batch with numpy, no
per-row Python.  Single-element reads (first feature, first byte) are plain
Catalyst expressions so they stay inside whole-stage codegen and decode
nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the payload format: big-endian IEEE-754 float32, 4 bytes each.
FLOAT_BYTES = 4
WIRE_DTYPE = ">f4"


def _combine(arr):
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def _binary_parts(arr: pa.Array):
    """Return (starts, lengths, data uint8 view, valid mask) of a binary array."""
    arr = _combine(arr)
    n = len(arr)
    large = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    off_dtype = np.int64 if large else np.int32
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=off_dtype, count=arr.offset + n + 1)[arr.offset:]
    offs = offs.astype(np.int64)
    valid = np.asarray(arr.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    lengths = np.where(valid, offs[1:] - offs[:-1], 0)
    data = (np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None
            else np.zeros(0, dtype=np.uint8))
    return offs[:-1], lengths, data, valid


def _gather(starts: np.ndarray, takes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Concatenate ``data[s:s+t]`` for every (s, t) in row order, vectorised.

    Contiguous runs are returned as a view.  Otherwise the kept byte ranges
    are marked with an int8 +1/-1 delta array whose running sum is the keep
    mask: about two bytes of scratch per payload byte, never a per-byte index.
    """
    total = int(takes.sum())
    if total == 0:
        return np.zeros(0, dtype=np.uint8)
    nz = takes > 0
    s, t = starts[nz], takes[nz]
    if np.array_equal(s[1:], s[:-1] + t[:-1]):
        return data[s[0]:s[0] + total]          # one contiguous run: no copy
    lo, hi = int(s[0]), int(s[-1] + t[-1])
    delta = np.zeros(hi - lo + 1, dtype=np.int8)
    np.add.at(delta, s - lo, 1)
    np.add.at(delta, s + t - lo, -1)
    keep = np.cumsum(delta[:-1], dtype=np.int8).astype(bool)
    return data[lo:hi][keep]


def _list_array(values: pa.Array, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offs, type=pa.int32()), values, mask=mask)


def encode_be_f32_arrow(arr: pa.Array) -> pa.Array:
    """list<float> -> binary, 4 big-endian bytes per element.  A vector with a null
    element has no payload (null), so it is rejected instead of scored as a NaN."""
    arr = _combine(arr)
    holes = arr.flatten().null_count
    if holes:
        whole = np.ones(len(arr), dtype=bool)
        whole[pc.list_parent_indices(arr).filter(pc.is_null(pc.list_flatten(arr))).to_numpy()] = False
        arr = pc.if_else(pa.array(whole), arr, pa.scalar(None, arr.type))
    n = len(arr)
    counts = pc.list_value_length(arr).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(arr).cast(pa.float32())
    vals = flat.to_numpy(zero_copy_only=False)
    data = np.ascontiguousarray(vals, dtype=np.float32).astype(WIRE_DTYPE).tobytes()
    offs = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(counts.astype(np.int64) * FLOAT_BYTES, out=offs[1:])
    validity = None
    if arr.null_count:
        validity = pc.is_valid(arr).buffers()[1]
        if arr.offset:  # re-pack the bitmap for a sliced input
            validity = pa.array(pc.is_valid(arr).to_numpy(zero_copy_only=False)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n,
                                 [validity, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])


def decode_be_f32_arrow(arr: pa.Array) -> pa.Array:
    """binary -> list<float>; keeps floor(len/4) elements, null stays null."""
    starts, lengths, data, valid = _binary_parts(arr)
    keep = (lengths // FLOAT_BYTES) * FLOAT_BYTES
    raw = _gather(starts, keep, data)
    floats = np.frombuffer(raw.tobytes() if not raw.flags.c_contiguous else raw,
                           dtype=WIRE_DTYPE).astype(np.float32)
    return _list_array(pa.array(floats, type=pa.float32()), keep // FLOAT_BYTES, valid)


def scale_bytes_arrow(arr: pa.Array, divisor: float) -> pa.Array:
    """binary -> list<float>: each unsigned byte divided by ``divisor`` in float32."""
    starts, lengths, data, valid = _binary_parts(arr)
    raw = _gather(starts, lengths, data)
    vals = raw.astype(np.float32) / np.float32(divisor)
    return _list_array(pa.array(vals, type=pa.float32()), lengths, valid)


_FLOAT_LIST = T.ArrayType(T.FloatType())


@F.arrow_udf(T.BinaryType())
def _encode_udf(v: pa.Array) -> pa.Array:
    return encode_be_f32_arrow(v)


@F.arrow_udf(_FLOAT_LIST)
def _decode_udf(v: pa.Array) -> pa.Array:
    return decode_be_f32_arrow(v)


def encode_features(col) -> Column:
    """Float vector -> big-endian float32 payload."""
    c = F.col(col) if isinstance(col, str) else col
    return _encode_udf(c.cast("array<float>"))       # no-op cast when already float


def decode_features(col) -> Column:
    """Big-endian float32 payload -> ARRAY<FLOAT>."""
    c = F.col(col) if isinstance(col, str) else col
    return _decode_udf(c)


def scale_bytes(col, divisor: float = 255.0) -> Column:
    """Unsigned bytes -> floats divided by ``divisor`` (225 in the streaming
    image job, 255 in the batch image job)."""
    c = F.col(col) if isinstance(col, str) else col
    d = float(divisor)

    @F.arrow_udf(_FLOAT_LIST)
    def _scale(v: pa.Array) -> pa.Array:
        return scale_bytes_arrow(v, d)

    return _scale(c)


SUM_WINDOW_BYTES = 1 << 23


def scaled_sums_arrow(arr: pa.Array, divisors, window: int = SUM_WINDOW_BYTES) -> pa.Array:
    """Per row: byte count and, for each divisor, the float64 sum of the P6
    float32 values (the same arithmetic as ``scale_bytes_arrow``).

    Rows are reduced in consecutive groups of about ``window`` payload bytes,
    so scratch memory stays bounded (a single larger row is its own group)."""
    starts, lengths, data, valid = _binary_parts(arr)
    n = len(lengths)
    sums = np.zeros((len(divisors), n))
    if n:
        first = np.zeros(n, dtype=np.int64)
        np.cumsum(lengths[:-1], out=first[1:])           # start of each row in the packed bytes
        group = first // window
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, n]):
            ln = lengths[a:b]
            raw = _gather(starts[a:b], ln, data).astype(np.float32)
            nz = ln > 0
            if not nz.any():
                continue
            pos = np.zeros(b - a, dtype=np.int64)
            np.cumsum(ln[:-1], out=pos[1:])
            for j, d in enumerate(divisors):
                vals = (raw / np.float32(d)).astype(np.float64)
                sums[j, a:b][nz] = np.add.reduceat(vals, pos[nz])
    fields, cols = [pa.field("n", pa.int64())], [pa.array(lengths.astype(np.int64))]
    for j in range(len(divisors)):
        fields.append(pa.field(f"s{j}", pa.float64()))
        cols.append(pa.array(sums[j]))
    return pa.StructArray.from_arrays(cols, fields=fields, mask=pa.array(~valid))


def scaled_sums(col, divisors=(225.0, 255.0)) -> Column:
    """P6 check aggregate: ``struct(n, s0, s1, ...)`` per row, reduced on the
    executors so only a few numbers per row come back from Python."""
    c = F.col(col) if isinstance(col, str) else col
    ds = [float(d) for d in divisors]
    out = T.StructType([T.StructField("n", T.LongType())]
                       + [T.StructField(f"s{j}", T.DoubleType()) for j in range(len(ds))])

    @F.arrow_udf(out)
    def _sums(v: pa.Array) -> pa.Array:
        return scaled_sums_arrow(v, ds)

    return _sums(c)


def decode_timed(col) -> Column:
    """P2 + P12: decode whole payloads in one Arrow pass and time it per batch.
    Returns ``struct(first FLOAT, start_ms, decode_ns, end_ms)``: the first
    element plus the batch's wall clock and apportioned decode time."""
    import time

    c = F.col(col) if isinstance(col, str) else col
    out = T.StructType([T.StructField("first", T.FloatType()),
                        T.StructField("start_ms", T.LongType()),
                        T.StructField("decode_ns", T.LongType()),
                        T.StructField("end_ms", T.LongType())])
    fields = [pa.field("first", pa.float32()), pa.field("start_ms", pa.int64()),
              pa.field("decode_ns", pa.int64()), pa.field("end_ms", pa.int64())]

    def run(v: pa.Array) -> pa.Array:
        n = len(v)
        start_ms = time.time_ns() // 1_000_000
        t0 = time.perf_counter_ns()
        lists = decode_be_f32_arrow(v)
        t1 = time.perf_counter_ns()
        first = pc.list_element(pc.if_else(pc.greater(pc.list_value_length(lists), 0), lists,
                                           pa.nulls(n, lists.type)), 0) if n else pa.array([], pa.float32())
        end_ms = time.time_ns() // 1_000_000
        per = (t1 - t0) // max(n, 1)
        return pa.StructArray.from_arrays(
            [first.cast(pa.float32()), pa.array(np.full(n, start_ms, dtype=np.int64)),
             pa.array(np.full(n, per, dtype=np.int64)), pa.array(np.full(n, end_ms, dtype=np.int64))],
            fields=fields)

    return F.arrow_udf(run, out).asNondeterministic()(c)


def _word_bits(v: Column, index: int) -> Column:
    word = F.substring(v, FLOAT_BYTES * index + 1, FLOAT_BYTES)
    return F.conv(F.hex(word), 16, 10).cast("bigint")


def be_float_at(col, index: int = 0) -> Column:
    """P4 native: element ``index`` of a big-endian float32 payload, in Catalyst.

    Rebuilds the IEEE-754 value from sign/exponent/mantissa with exact double
    arithmetic (powers of two are exact), so NaN, +-Inf, -0.0 and subnormals
    come out bit-exact.  Null when the payload is shorter than the element.
    """
    v = F.col(col) if isinstance(col, str) else col
    bits = _word_bits(v, index)
    sign = F.shiftright(bits, 31)
    exp = F.shiftright(bits, 23).bitwiseAND(0xFF)
    man = bits.bitwiseAND(0x7FFFFF)
    mag = (F.when(exp == 0, man.cast("double") * F.lit(2.0 ** -149))
           .when(exp == 255, F.when(man == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
           .otherwise((F.lit(1.0) + man.cast("double") / F.lit(float(1 << 23)))
                      * F.pow(F.lit(2.0), (exp - 127).cast("double"))))
    val = F.when(sign == 1, -mag).otherwise(mag).cast("float")
    return F.when(F.length(v) >= FLOAT_BYTES * (index + 1), val)


def first_feature(col) -> Column:
    """First element of the payload (what the pass-through job reports)."""
    return be_float_at(col, 0)


def float_text(col) -> Column:
    """Number -> text the way the JVM prints a float (``1.0E-5``, ``123456.79``)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string")


def first_byte_signed(col) -> Column:
    """P5: first payload byte as a signed value in [-128, 127]; null when empty."""
    v = F.col(col) if isinstance(col, str) else col
    u = F.conv(F.hex(F.substring(v, 1, 1)), 16, 10).cast("int")
    return F.when(u > 127, u - 256).otherwise(u)


def send_time(col) -> Column:
    """Key bytes -> text, decoded like a JVM ``new String(bytes)``.

    Valid UTF-8 (the normal case) is a plain cast.  Invalid bytes become
    U+FFFD with the JVM decoder's grouping: one replacement per malformed
    byte, except that a UTF-8-encoded surrogate (ED, then A0-BF, then a
    continuation byte) is one malformed unit, as is ED A0-BF on its own.
    Those units are rewritten to a single invalid byte before
    ``make_valid_utf8``.  Everything stays in Catalyst; the rewrite runs only
    for invalid keys.
    """
    v = F.col(col) if isinstance(col, str) else col
    text = v.cast("string")
    pairs = F.regexp_replace(F.hex(v), "(..)", "$1 ")
    pairs = F.regexp_replace(pairs, "ED [AB][0-9A-F] [89AB][0-9A-F] ", "FF ")
    pairs = F.regexp_replace(pairs, "ED [AB][0-9A-F] ", "FF ")
    rebuilt = F.unhex(F.regexp_replace(pairs, " ", "")).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.make_valid_utf8(rebuilt))


def epoch_millis(ts_col, ntz: bool = False) -> Column:
    """Epoch milliseconds (truncated) of a timestamp.  A TIMESTAMP_NTZ is read
    as UTC wall time without consulting the session time zone."""
    ts = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    if ntz:
        us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
        return F.floor(us / 1000).cast("bigint")
    return F.unix_millis(ts)


def send_time_key(ts_col, ntz: bool = False) -> Column:
    """P13 for replayable data: the epoch-millis text of an event timestamp, as bytes.

    The per-record wall clock of a live producer is not reproducible; a
    deterministic key is taken from the row's own time instead.
    """
    return epoch_millis(ts_col, ntz).cast("string").cast("binary")


def _clock(values: pa.Array) -> pa.Array:
    """Epoch milliseconds at which each record of the batch is reached, as text."""
    import time
    now = [time.time_ns() // 1_000_000 for _ in range(len(values))]
    return pa.array([str(t).encode() for t in now], pa.binary())


def clock_key(record) -> Column:
    """P13 live form: the wall clock read for each record, as key text.  Evaluated
    in Python next to the encoder; records sent within a millisecond share a key."""
    c = F.col(record) if isinstance(record, str) else record
    return F.arrow_udf(_clock, T.BinaryType()).asNondeterministic()(c)


_BYTE_TIMES = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()),
                            T.StructField("first", T.IntegerType())])


def _first_byte_timed(values: pa.Array) -> pa.Array:
    import time
    start = time.time_ns() // 1_000_000
    starts, lengths, data, valid = _binary_parts(values)
    some = valid & (lengths > 0)
    first = np.zeros(len(lengths), np.int32)
    first[some] = data[starts[some]].astype(np.int8)
    n, end = len(lengths), time.time_ns() // 1_000_000
    return pa.StructArray.from_arrays(
        [pa.array(np.full(n, start)), pa.array(np.full(n, end)), pa.array(first, mask=~some)],
        names=["start_ms", "end_ms", "first"])


def first_byte_timed(col) -> Column:
    """P5 with the clock read before and after each batch: (start_ms, end_ms, first)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.arrow_udf(_first_byte_timed, _BYTE_TIMES).asNondeterministic()(c)
