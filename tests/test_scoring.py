import math

import numpy as np
from pyspark.sql import functions as F

from framescore.operators.evaluate import accuracy
from framescore.operators.models import (DenseSoftmax, LstmSoftmax, byte_weights,
                                         fit_centroids, softmax)
from framescore.operators.scoring import score
from framescore.plans import jobs
from framescore.sources.tables import embedding_records, table

SF = "/root/testdata/sf0.001"


def _lstm_rowwise(m: LstmSoftmax, x):
    """Plain per-row reference of the same LSTM (golden)."""
    out = []
    for row in np.asarray(x, dtype=np.float64):
        h = np.zeros(m.hidden)
        c = np.zeros(m.hidden)
        for t in range(m.steps):
            xt = row[t * m.features:(t + 1) * m.features]
            z = m.w_in @ xt + m.w_rec @ h + m.b
            hd = m.hidden
            sig = lambda v: 1 / (1 + math.e ** (-v))
            i, f = sig(z[:hd]), sig(z[hd:2 * hd])
            g, o = np.tanh(z[2 * hd:3 * hd]), sig(z[3 * hd:])
            c = f * c + i * g
            h = o * np.tanh(c)
        logit = m.w_out @ h + m.b_out
        e = np.exp(logit - logit.max())
        out.append(e / e.sum())
    return np.array(out)


def test_lstm_matches_rowwise_golden():
    m = LstmSoftmax.seeded()
    x = np.random.default_rng(1).normal(0, 0.3, (7, m.width)).astype(np.float32)
    assert np.allclose(m.predict(x), _lstm_rowwise(m, x), atol=1e-12)
    assert np.allclose(m.predict(x).sum(axis=1), 1.0, atol=1e-9)


def test_softmax_and_dense():
    w = byte_weights(6, 3)
    assert w.shape == (3, 6) and w.min() >= -8 and w.max() <= 8
    m = DenseSoftmax(w)
    p = m.predict(np.ones((2, 6), dtype=np.float32))
    assert np.allclose(p.sum(axis=1), 1)
    assert np.allclose(softmax(np.array([[1000.0, 1000.0]])), 0.5)


def test_fit_centroids_matches_numpy(spark):
    e = table(spark, SF, "embeddings")
    m = fit_centroids(e, "embedding", "label")
    pdf = e.toPandas()
    X = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    for k in range(m.classes):
        assert np.allclose(m.weights[k], X[pdf["label"].to_numpy() == k].mean(axis=0), atol=1e-12)


def test_score_independent_of_batch_size_and_partitions(spark):
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")
    recs = embedding_records(spark, SF).select("offset", "partition", "value")
    base = {(r[0], r[1]): r[2] for r in score(recs, m, features="value", input="f32be")
            .select("offset", "partition", "label").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        other = {(r[0], r[1]): r[2] for r in score(recs.repartition(5), m, features="value",
                                                   input="f32be")
                 .select("offset", "partition", "label").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert base == other and len(base) == 500


def test_score_numpy_agrees(spark):
    e = table(spark, SF, "embeddings")
    m = fit_centroids(e, "embedding", "label")
    got = {r["vec_id"]: (r["label"], r["prob"]) for r in
           score(e.select("vec_id", "embedding"), m, features="embedding").collect()}
    pdf = e.toPandas()
    X = np.stack(pdf["embedding"].to_numpy())
    p = m.predict(X)
    for vid, row in zip(pdf["vec_id"], p):
        lab, prob = got[vid]
        assert lab == int(np.argmax(row)) and abs(prob - row.max()) < 1e-12


def test_bad_width_rows_get_null_label(spark):
    m = DenseSoftmax(np.eye(2))
    df = spark.createDataFrame([([1.0, 0.0],), ([1.0],), (None,), ([0.0, 3.0],)], "f array<float>")
    got = [r["label"] for r in score(df, m, features="f", timings=False).collect()]
    assert got == [0, None, None, 1]


def test_stage_times_non_negative(spark):
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")
    out = jobs.scored(embedding_records(spark, SF), m)
    bad = out.where((F.col("tensor_ns") < 0) | (F.col("infer_ns") < 0) | (F.col("post_ns") < 0)
                    | (F.col("end_ms") < F.col("start_ms")))
    assert bad.count() == 0
    line = out.select("value").first()[0]
    assert len(line.split(" : ")) == 9


def test_accuracy_join(spark):
    pred = spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "k long, label int")
    truth = spark.createDataFrame([(1, 3), (2, 0), (3, 5), (4, 1)], "k long, label int")
    r = accuracy(pred, truth, "k").first()
    assert (r["n"], r["n_correct"]) == (3, 2) and abs(r["accuracy"] - 2 / 3) < 1e-15


def test_image_job_bare_labels(spark):
    m = DenseSoftmax(byte_weights(4, 3))
    df = spark.createDataFrame([(bytes([1, 2, 3, 4]),), (bytes([9, 9]),)], "value binary")
    got = jobs.bare_labels(df, m, 225.0).collect()
    x = np.array([[1, 2, 3, 4]], dtype=np.float32) / np.float32(225)
    assert got[0]["value"] == str(int(np.argmax(m.predict(x)[0])))
    assert got[1]["label"] is None


def test_onnx_query_twice_in_one_session(spark):
    from __spark_entry__ import queries
    q = queries()["score_onnx"]
    a = {tuple(r) for r in q(spark, SF).collect()}
    b = {tuple(r) for r in q(spark, SF).collect()}
    assert a == b and len(a) == 500


def test_onnx_model_matches_dense(spark):
    from framescore.operators.models import OnnxModel
    from framescore.operators.onnx_export import dense_to_onnx
    w = np.random.default_rng(3).normal(size=(4, 6))
    x = np.random.default_rng(4).normal(size=(9, 6)).astype(np.float32)
    dense = DenseSoftmax(w)
    onnx = OnnxModel(dense_to_onnx(w), 6, 4)
    assert np.allclose(dense.predict(x), onnx.predict(x), atol=1e-6)


def test_passthrough_timed_equals_native(spark):
    recs = embedding_records(spark, SF)
    native = {(r["partition"], r["offset"]): r["ans"]
              for r in jobs.passthrough(recs, timed=False).collect()}
    timed = jobs.passthrough(recs).collect()
    assert {(r["partition"], r["offset"]): r["ans"] for r in timed} == native
    assert all(r["decode_ns"] >= 0 and r["end_ms"] >= r["start_ms"] for r in timed)
    assert all(len(r["value"].split(" : ")) == 7 for r in timed)


def test_onnx_bad_model_fails_on_driver(scratch):
    import os

    import pytest

    from framescore.operators.models import OnnxModel, ship_model_file
    from framescore.operators.onnx_export import dense_to_onnx
    with pytest.raises(Exception):
        OnnxModel(b"not a model")
    m = OnnxModel(dense_to_onnx(np.ones((3, 5))))
    assert (m.width, m.classes) == (5, 3)
    bad = os.path.join(scratch, "bad.onnx")
    with open(bad, "wb") as fh:
        fh.write(b"\x00garbage")
    with pytest.raises(Exception):
        ship_model_file(None, bad)


def test_scores_are_distributions_and_labels_in_range(spark):
    """SURVEY §5 properties on Spark output: sum(softmax) = 1 +- 1e-5, label in [0, k)."""
    recs = embedding_records(spark, SF)
    for model in (fit_centroids(table(spark, SF, "embeddings"), "embedding", "label"),
                  LstmSoftmax.seeded()):
        out = score(recs.select("offset", "partition", "value"), model, features="value",
                    input="f32be", timings=False)
        bad = out.where((F.abs(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-5)
                        | (F.col("label") < 0) | (F.col("label") >= model.classes)
                        | (F.size("scores") != model.classes))
        assert out.count() == 500 and bad.count() == 0


def test_fit_centroids_label_checks(spark):
    import pytest
    df = spark.createDataFrame([([1.0, 2.0], 0), ([3.0, 4.0], None), ([5.0, 6.0], 1)],
                               "f array<float>, y int")
    m = fit_centroids(df, "f", "y")
    assert np.allclose(m.weights, [[1.0, 2.0], [5.0, 6.0]])
    bad = spark.createDataFrame([([1.0, 2.0], -1)], "f array<float>, y int")
    with pytest.raises(ValueError):
        fit_centroids(bad, "f", "y")


def test_float32_dense_same_labels(spark):
    e = table(spark, SF, "embeddings")
    m64 = fit_centroids(e, "embedding", "label")
    m32 = DenseSoftmax(m64.weights, dtype=np.float32)
    X = np.stack(e.toPandas()["embedding"].to_numpy()).astype(np.float32)
    assert (m64.predict(X).argmax(1) == m32.predict(X).argmax(1)).all()
    assert m32.predict(X).dtype == np.float32


def test_output_schemas_match_fixtures(spark, scratch):
    """Typed outputs R7, R9, R4, R1 and RA have the FIXTURES.md column types."""
    from framescore.plans.catalog import _write_icons
    recs = embedding_records(spark, SF)
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")

    def types(df, cols):
        return [dict(df.dtypes)[c] for c in cols]

    r7 = jobs.passthrough(recs)
    assert types(r7, ["send_time", "start_ms", "decode_ns", "end_ms", "partition", "offset",
                      "ans"]) == ["string", "bigint", "bigint", "bigint", "int", "bigint", "string"]
    r9 = jobs.scored(recs, m)
    assert types(r9, ["send_time", "start_ms", "tensor_ns", "infer_ns", "post_ns", "end_ms",
                      "partition", "offset", "label"]) == [
        "string", "bigint", "bigint", "bigint", "bigint", "bigint", "int", "bigint", "int"]
    r4 = jobs.keyvalue(recs)
    assert types(r4, ["send_time", "start_ms", "end_ms", "first_byte"]) == [
        "string", "bigint", "bigint", "int"]
    r1 = jobs.bare_labels(recs.select("value"), DenseSoftmax(byte_weights(256, 10)))
    assert types(r1, ["label"]) == ["int"]
    ra = jobs.image_accuracy(spark, _write_icons(spark, SF),
                             DenseSoftmax(byte_weights(64, 10)), 255.0)
    assert ra.dtypes == [("n", "bigint"), ("n_correct", "bigint"), ("accuracy", "double")]
    assert all(dict(df.dtypes)["value"] == "string" for df in (r7, r9, r4, r1))


def test_fit_centroids_sparse_labels_in_one_pass(spark, capsys):
    """Classes are the distinct labels: 0 and 50,000,000 are a model of two rows."""
    rows = [([1.0, 2.0], 0), ([3.0, 4.0], 50_000_000), ([5.0, 8.0], 50_000_000), ([9.0, None], 0), (None, 0)]
    df = spark.createDataFrame(rows, "f array<float>, y int")
    m = fit_centroids(df, "f", "y")
    assert np.allclose(m.weights, [[1.0, 2.0], [4.0, 6.0]]) and m.labels.tolist() == [0, 50_000_000]
    got = score(df.limit(3), m, features="f", timings=False).collect()
    assert {r["label"] for r in got} == {50_000_000}


def test_scored_job_carries_no_scores(spark):
    m = DenseSoftmax(np.eye(64))
    plan = jobs.scored(embedding_records(spark, SF), m)._jdf.queryExecution().executedPlan().toString()
    assert "scores" not in plan


def test_model_file_is_shipped_once(spark):
    from framescore.operators.models import ship_model
    m = DenseSoftmax(np.eye(3))
    assert ship_model(spark, m) == ship_model(spark, DenseSoftmax(np.eye(3)))
