import numpy as np
from pyspark.sql import functions as F

from framescore.functions.argmax import argmax_label, winning_class
from framescore.functions.trace import return_topic, trace_line

NAN = float("nan")
CASES = [([NAN, .3, .3], 1), ([-1.0, -2.0], 0), ([NAN], 0), ([.1, .7, .7], 1), ([], 0),
         ([0.0, 0.0], 0), ([.2, NAN, .9], 2)]


def test_argmax_fold(spark):
    df = spark.createDataFrame([(c,) for c, _ in CASES], "s array<float>")
    got = [r[0] for r in df.select(argmax_label("s")).collect()]
    assert got == [w for _, w in CASES]


def test_argmax_numpy_same_rule():
    for scores, want in CASES:
        if scores:
            assert winning_class(np.array([scores]))[0] == want
    assert winning_class(np.zeros((3, 0))).tolist() == [0, 0, 0]


def test_trace_layouts(spark):
    row = spark.createDataFrame(
        [("1700000000000", 1, 2, 3, 4, 5, 6, 7, 8, "0.5", 9, -3)],
        "send_time string, start_ms long, decode_ns long, tensor_ns long, infer_ns long, "
        "post_ns long, end_ms long, partition int, offset long, ans string, label int, "
        "first_byte int")
    out = row.select(trace_line("passthrough").alias("a"), trace_line("scored").alias("b"),
                     trace_line("keyvalue").alias("c"),
                     return_topic("stair").alias("t")).first()
    assert out["a"] == "1700000000000 : 1 : 2 : 6 : 7 : 8 : 0.5"
    assert out["b"] == "1700000000000 : 1 : 3 : 4 : 5 : 6 : 7 : 8 : 9"
    assert out["c"] == "1700000000000 1 6 -3"
    assert out["t"] == "stair-return"


def test_trace_null_field_nulls_line(spark):
    row = spark.createDataFrame([(None, 1, 2, 3)], "send_time string, start_ms long, "
                                "end_ms long, first_byte int")
    assert row.select(trace_line("keyvalue")).first()[0] is None
    assert row.select(return_topic(F.lit("t"))).first()[0] == "t-return"


def test_fold_equals_numpy_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    values = st.one_of(st.sampled_from([float("nan"), 0.0, -0.0, 0.5, 0.25]),
                       st.floats(-2, 2, width=32))
    rows = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(values, min_size=0, max_size=6))
    def collect(v):
        rows.append(v)

    collect()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<float>")
    got = {r[0]: r[1] for r in df.select("i", argmax_label("s")).collect()}
    for i, r in enumerate(rows):
        want = winning_class(np.array([r], dtype=np.float32))[0] if r else 0
        assert got[i] == want, (r, got[i], want)
