import math
import struct

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framescore.functions.codec import (be_float_at, decode_be_f32_arrow, decode_features,
                                        encode_be_f32_arrow, encode_features,
                                        first_byte_signed, scale_bytes, scale_bytes_arrow,
                                        send_time)

EDGE = [0.0, -0.0, 1.0, -1.5, float("nan"), float("inf"), float("-inf"), 1e-45, 3.4e38,
        1.17549435e-38, 123456.79]


def _be(values):
    return struct.pack(f">{len(values)}f", *values)


def _same_float(a, b):
    return struct.pack(">f", a) == struct.pack(">f", b) or (math.isnan(a) and math.isnan(b))


def test_encode_matches_struct_pack():
    arr = pa.array([EDGE, [], None, [2.5]], type=pa.list_(pa.float32()))
    out = encode_be_f32_arrow(arr).to_pylist()
    assert out[0] == _be(EDGE)
    assert out[1] == b""
    assert out[2] is None
    assert out[3] == _be([2.5])


def test_decode_keeps_floor_len_over_4():
    payloads = [_be(EDGE), b"", b"\x01\x02\x03", _be([1.0]) + b"\x07", None, _be([2.0, 3.0])]
    out = decode_be_f32_arrow(pa.array(payloads, type=pa.binary())).to_pylist()
    assert len(out[0]) == len(EDGE)
    assert all(_same_float(a, b) for a, b in zip(out[0], EDGE))
    assert out[1] == [] and out[2] == []
    assert out[3] == [1.0]
    assert out[4] is None
    assert out[5] == [2.0, 3.0]


def test_decode_sliced_input():
    arr = pa.array([_be([1.0]), _be([2.0, 3.0]), _be([4.0])], type=pa.binary()).slice(1, 2)
    assert decode_be_f32_arrow(arr).to_pylist() == [[2.0, 3.0], [4.0]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(width=32, allow_nan=False), max_size=20), max_size=20))
def test_roundtrip_property(rows):
    arr = pa.array(rows, type=pa.list_(pa.float32()))
    enc = encode_be_f32_arrow(arr)
    assert [len(b) for b in enc.to_pylist()] == [4 * len(r) for r in rows]
    dec = decode_be_f32_arrow(enc).to_pylist()
    for a, b in zip(dec, rows):
        assert all(_same_float(x, y) for x, y in zip(a, b)) and len(a) == len(b)


def test_scale_bytes_both_divisors():
    raw = bytes([0, 1, 127, 128, 255])
    for d in (225.0, 255.0):
        got = scale_bytes_arrow(pa.array([raw], type=pa.binary()), d).to_pylist()[0]
        want = [float(np.float32(b) / np.float32(d)) for b in raw]
        assert got == want


def test_spark_codecs(spark):
    rows = [(_be(EDGE),), (b"\x80\x00\x00\x00",), (b"\x00\x7f",), (b"\xff",), (b"",), (None,)]
    df = spark.createDataFrame(rows, "v binary")
    out = df.select(decode_features("v").alias("d"), be_float_at("v", 0).alias("x0"),
                    be_float_at("v", 3).alias("x3"), first_byte_signed("v").alias("b"),
                    scale_bytes("v", 225.0).alias("s")).collect()
    assert all(_same_float(a, b) for a, b in zip(out[0]["d"], EDGE))
    assert _same_float(out[0]["x0"], 0.0) and _same_float(out[1]["x0"], -0.0)
    assert math.isnan(out[0]["x3"] if out[0]["x3"] is not None else 0.0) is False
    assert _same_float(out[0]["x3"], EDGE[3])
    assert [r["b"] for r in out] == [0, -128, 0, -1, None, None]
    assert out[2]["x0"] is None and out[4]["d"] == [] and out[5]["d"] is None
    # every edge value read natively, bit for bit
    one = spark.createDataFrame([(_be(EDGE),)], "v binary")
    got = one.select(*[be_float_at("v", i).alias(f"x{i}") for i in range(len(EDGE))]).first()
    assert all(_same_float(got[f"x{i}"], EDGE[i]) for i in range(len(EDGE)))


def test_spark_encode_roundtrip(spark):
    df = spark.createDataFrame([([1.0, -2.5, 3e-5],), ([],)], "f array<float>")
    out = df.select(encode_features("f").alias("e")).select(
        "e", decode_features("e").alias("d")).collect()
    assert out[0]["e"] == _be([1.0, -2.5, 3e-5])
    assert out[0]["d"] == [1.0, -2.5, float(np.float32(3e-5))]
    assert out[1]["d"] == []


def test_send_time_replaces_bad_utf8(spark):
    df = spark.createDataFrame([(b"\xff1",), (b"1700000000000",)], "k binary")
    got = [r[0] for r in df.select(send_time("k")).collect()]
    assert got == ["�1", "1700000000000"]


def test_float_text_is_jvm_style(spark):
    df = spark.createDataFrame([(1e-5,), (1e10,), (123456.79,)], "x float")
    got = [r[0] for r in df.select(F.col("x").cast("string")).collect()]
    assert got == ["1.0E-5", "1.0E10", "123456.79"]


def test_scaled_sums_match_scaled_arrays():
    from framescore.functions.codec import scaled_sums_arrow
    rows = [bytes(range(256)), b"", None, bytes([200] * 1000), b"\x01"]
    arr = pa.array(rows, type=pa.binary())
    got = scaled_sums_arrow(arr, [225.0, 255.0]).to_pylist()
    for r, g in zip(rows, got):
        if r is None:
            assert g is None
            continue
        assert g["n"] == len(r)
        for key, d in (("s0", 225.0), ("s1", 255.0)):
            want = sum(float(np.float32(b) / np.float32(d)) for b in r)
            assert abs(g[key] - want) < 1e-9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 12)), max_size=15))
def test_gather_matches_python_slices(rows):
    from framescore.functions.codec import _binary_parts, _gather
    arr = pa.array([b for b, _ in rows], type=pa.binary())
    starts, lengths, data, _ = _binary_parts(arr)
    takes = np.array([min(k, len(b)) for b, k in rows], dtype=np.int64)
    got = bytes(_gather(starts, takes, data)) if rows else b""
    assert got == b"".join(b[:k] for b, k in rows)


def test_scaled_sums_windows_do_not_change_results():
    from framescore.functions.codec import scaled_sums_arrow
    rng = np.random.default_rng(5)
    rows = [bytes(rng.integers(0, 256, size=int(k), dtype=np.uint8)) for k in
            rng.integers(0, 300, size=40)] + [None, b""]
    arr = pa.array(rows, type=pa.binary())
    wide = scaled_sums_arrow(arr, [225.0, 255.0]).to_pylist()
    for window in (1, 7, 256, 1000):
        narrow = scaled_sums_arrow(arr, [225.0, 255.0], window=window).to_pylist()
        for a, b in zip(wide, narrow):
            assert (a is None and b is None) or (
                a["n"] == b["n"] and abs(a["s0"] - b["s0"]) < 1e-9 and abs(a["s1"] - b["s1"]) < 1e-9)


def test_float_text_equals_jvm_float_tostring(spark):
    """P4 text: Spark's float -> string equals the JVM's Float.toString (what the
    original jobs print), on edge values and on every first feature of embeddings."""
    jvm = spark.sparkContext._jvm
    edge = [float("inf"), float("-inf"), -0.0, 1.4e-45, 3.4028235e38, 0.1, 12345678.0, 1e-4]
    firsts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
              .select(F.col("embedding")[0]).collect()]
    df = spark.createDataFrame([(v,) for v in edge + firsts], "x float")
    for r in df.select("x", F.col("x").cast("string").alias("s")).collect():
        bits = struct.unpack(">i", struct.pack(">f", r["x"]))[0]
        want = jvm.java.lang.Float.toString(jvm.java.lang.Float.intBitsToFloat(bits))
        assert r["s"] == want, (r["x"], r["s"], want)


def test_send_time_matches_jvm_decoder(spark):
    """P7 parity: same replacement characters as the JVM's new String(bytes, UTF-8),
    surrogate encodings and truncated sequences included."""
    import random
    rng = random.Random(7)
    alphabet = [0x31, 0xC2, 0xC3, 0xA9, 0xE0, 0xE2, 0xED, 0xEF, 0x82, 0xAC, 0xF0, 0xF4, 0xF5,
                0x9F, 0x80, 0x90, 0xBF, 0xFF, 0xC0, 0xA0]
    cases = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    cases += [b"\xed\xa0\x80", b"\xed\xbf", b"\xed\xa9\xa9\xf4\xe2", b"1700000000000"]
    df = spark.createDataFrame([(c,) for c in cases], "k binary")
    got = [r[0] for r in df.select(send_time("k")).collect()]
    jvm = spark.sparkContext._jvm
    utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
    for c, g in zip(cases, got):
        assert g == jvm.java.lang.String(bytearray(c), utf8), c.hex()


def test_be_float_at_random_bit_patterns(spark):
    """The Catalyst IEEE-754 rebuild equals struct.unpack on random 32-bit patterns
    (all NaN encodings read as NaN; every other value bit for bit)."""
    import random
    rng = random.Random(5)
    words = [rng.getrandbits(32) for _ in range(2000)]
    words += [0x00000000, 0x80000000, 0x00000001, 0x807FFFFF, 0x7F800000, 0xFF800000,
              0x7FC00000, 0xFFFFFFFF, 0x7F7FFFFF, 0x00800000]
    payloads = [struct.pack(">I", w) + struct.pack(">I", rng.getrandbits(32)) for w in words]
    df = spark.createDataFrame([(p,) for p in payloads], "v binary")
    got = [r[0] for r in df.select(be_float_at("v", 0)).collect()]
    for p, g in zip(payloads, got):
        want = struct.unpack(">f", p[:4])[0]
        if math.isnan(want):
            assert math.isnan(g)
        else:
            assert struct.pack(">f", g) == p[:4], p[:4].hex()


def test_first_byte_signed_all_values(spark):
    df = spark.createDataFrame([(bytes([b, 7]),) for b in range(256)], "v binary")
    got = [r[0] for r in df.select(first_byte_signed("v")).collect()]
    assert got == [struct.unpack("b", bytes([b]))[0] for b in range(256)]
