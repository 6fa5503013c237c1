import gzip
import os
import struct

from pyspark.sql import functions as F

from framescore.operators.rejects import split_rejects, tag_rejects
from framescore.sources.csv import feature_csv, parse_features
from framescore.sources.idx import (LABEL_SUFFIX, idx_images, idx_labels, source_key,
                                    write_idx_pair)
from framescore.sources.records import from_offsets, kafka_options, record_stream


def test_rejects(spark):
    good = struct.pack(">2f", 1.0, 2.0)
    rows = [(None, good), (b"1", None), (b"1", b""), (b"1", b"abc"), (b"1", good + b"x"),
            (b"1", good), (b"1", good * 2)]
    df = spark.createDataFrame(rows, "key binary, value binary")
    got = [r[0] for r in tag_rejects(df, width=2).select("reject_reason").collect()]
    assert got == ["null_key", "null_value", "short_value", "short_value", None, None,
                   "bad_width"]
    ok, bad = split_rejects(df, width=2)
    assert ok.count() == 2 and bad.count() == 5


def test_csv_edge_rows(spark, scratch):
    path = os.path.join(scratch, "f.csv")
    with open(path, "w") as fh:
        fh.write("1,2,3\n")            # exact width
        fh.write("1,2,3,4,5\n")        # extra columns ignored
        fh.write("1,2\n")              # short
        fh.write("1,,3\n")             # empty field
        fh.write("1,x,3\n")            # not a number
        fh.write(" 1.5 ,NaN,Infinity\n")
    rows = feature_csv(spark, path, 3).collect()
    got = [(r["features"], r["reject_reason"]) for r in rows]
    assert got[0] == ([1.0, 2.0, 3.0], None)
    assert got[1] == ([1.0, 2.0, 3.0], None)
    assert got[2] == (None, "short_row")
    assert got[3] == (None, "bad_number")
    assert got[4] == (None, "bad_number")
    f = got[5][0]
    assert f[0] == 1.5 and f[1] != f[1] and f[2] == float("inf")


def test_parse_features_in_memory(spark):
    df = spark.createDataFrame([("1,2,3",), (None,)], "value string")
    got = parse_features(df, 2).collect()
    assert got[0]["features"] == [1.0, 2.0] and got[1]["reject_reason"] == "null_row"


def _write_gz(path, data):
    with open(path, "wb") as fh:
        fh.write(gzip.compress(data))


def test_idx_scan_golden(spark, scratch):
    imgs = bytes([0, 1, 2, 3, 255, 254, 253, 252, 7, 7, 7, 7])
    _write_gz(os.path.join(scratch, "t10k-images-idx3-ubyte.gz"),
              struct.pack(">iiii", 2051, 3, 2, 2) + imgs)
    _write_gz(os.path.join(scratch, "t10k-labels-idx1-ubyte.gz"),
              struct.pack(">ii", 2049, 3) + bytes([4, 9, 0]))
    im = idx_images(spark, scratch, chunk=2).orderBy("pos").collect()
    lb = idx_labels(spark, scratch).orderBy("pos").collect()
    assert [r["pixels"] for r in im] == [imgs[0:4], imgs[4:8], imgs[8:12]]
    assert [(r["rows"], r["cols"]) for r in im] == [(2, 2)] * 3
    assert [r["label"] for r in lb] == [4, 9, 0]
    assert {r["source"] for r in im} == {"t10k"} == {r["source"] for r in lb}
    assert source_key("/x/part-00003" + LABEL_SUFFIX) == "part-00003"


def test_idx_write_read_roundtrip(spark, scratch):
    df = spark.range(0, 50).select(
        F.col("id").alias("k"),
        F.unhex(F.lpad(F.hex(F.col("id") * 5 % 256), 8, "0")).alias("px"),
        (F.col("id") % 10).cast("int").alias("y"))
    out = os.path.join(scratch, "idx")
    manifest = write_idx_pair(df, out, "px", "y", 2, 2, "k", rows_per_file=16)
    assert manifest.agg(F.sum("n")).first()[0] == 50
    j = idx_images(spark, out).join(idx_labels(spark, out), ["source", "pos"])
    assert j.count() == 50
    want = {(r["px"], r["y"]) for r in df.collect()}
    assert {(r["pixels"], r["label"]) for r in j.collect()} == want


def test_kafka_option_mapping():
    o = kafka_options("stair", "h:9092", starting_offsets="earliest", max_offsets_per_trigger=10,
                      min_partitions=64)
    assert o == {"kafka.bootstrap.servers": "h:9092", "subscribe": "stair",
                 "kafka.group.id": "stair", "startingOffsets": "earliest",
                 "maxOffsetsPerTrigger": "10", "minPartitions": "64"}
    from framescore.sinks.results import kafka_sink_options, return_topic_reader_options
    assert return_topic_reader_options("stair", "h:9092")["subscribe"] == "stair-return"
    assert kafka_sink_options("stair-return", "h:9092", checkpoint="/c") == {
        "kafka.bootstrap.servers": "h:9092", "topic": "stair-return", "kafka.acks": "all",
        "checkpointLocation": "/c"}


def test_record_replay_projection_and_start(spark, scratch):
    from framescore.sinks.results import write_record_log
    from framescore.sources.tables import embedding_records
    path = os.path.join(scratch, "log")
    write_record_log(embedding_records(spark, "/root/testdata/sf0.001"), path)
    recs = record_stream(spark, "parquet", path=path, streaming=False)
    assert recs.columns == ["partition", "offset", "key", "value"]
    assert record_stream(spark, "parquet", path=path, streaming=False,
                         projection="keyvalue").columns == ["key", "value"]
    # partition 0 holds offsets 0..124; from 100 on leaves 25, other partitions keep 375
    assert from_offsets(recs, {0: 100}).count() == 400
    assert from_offsets(recs, 120).count() == 4 * 5


def test_idx_writer_bounded_files_without_shuffle(spark, scratch):
    df = spark.range(0, 61, numPartitions=2).select(
        F.lit(1).alias("k"), F.unhex(F.lit("00010203")).alias("px"), F.lit(3).alias("y"))
    out = os.path.join(scratch, "idx-dup")
    manifest = write_idx_pair(df, out, "px", "y", 2, 2, "k", rows_per_file=20)
    sizes = sorted(r["n"] for r in manifest.collect())
    assert sum(sizes) == 61 and max(sizes) == 20 and len(sizes) == 4
    j = idx_images(spark, out).join(idx_labels(spark, out), ["source", "pos"])
    assert j.count() == 61


def test_rejects_strict_mode_raises(spark):
    import pytest
    df = spark.createDataFrame([(b"1", b"\x00\x00\x80\x3f"), (None, b"\x00\x00\x80\x3f")],
                               "key binary, value binary")
    assert tag_rejects(df.limit(1), strict=True).count() == 1
    with pytest.raises(Exception, match="null_key"):
        tag_rejects(df, strict=True).collect()


def test_projections_and_batch_sinks(spark, scratch):
    from framescore.sinks.results import read_results, write_record_log, write_table, write_text
    from framescore.sources.tables import document_records
    log = os.path.join(scratch, "doclog")
    write_record_log(document_records(spark, "/root/testdata/sf0.001"), log)
    text = record_stream(spark, "parquet", path=log, streaming=False, projection="text")
    assert text.columns == ["value"] and dict(text.dtypes)["value"] == "string"
    assert record_stream(spark, "parquet", path=log, streaming=False,
                         projection="value").columns == ["value"]
    out = os.path.join(scratch, "lines")
    ids = record_stream(spark, "parquet", path=log, streaming=False, projection="all") \
        .select(F.col("key").cast("string").alias("value"))   # one-line values
    write_text(ids, out)
    write_text(ids.limit(3), out)                         # overwrite, not append
    assert spark.read.text(out).count() == 3
    tbl = os.path.join(scratch, "tbl")
    recs = record_stream(spark, "parquet", path=log, streaming=False)
    write_table(recs.select("partition", "offset"), tbl)
    first = read_results(spark, tbl, limit=5).collect()
    assert [(r["offset"], r["partition"]) for r in first] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]


def test_missing_kafka_connector_message(spark):
    import pytest
    with pytest.raises(RuntimeError, match="spark-sql-kafka-0-10_2.13"):
        record_stream(spark, "kafka", topic="stair", bootstrap="localhost:9092")


def test_missing_kafka_connector_message_on_sinks(spark, scratch):
    import pytest

    from framescore.sinks.results import publish_kafka
    from framescore.streaming.runner import start_stream
    df = spark.createDataFrame([(b"k", b"v")], "key binary, value binary")
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        publish_kafka(df, "stair", "localhost:9092")
    stream = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS value")
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        start_stream(stream, "kafka", os.path.join(scratch, "ck"), topic="t",
                     bootstrap="localhost:9092")


def test_null_elements_keep_their_place_and_are_rejected(spark, scratch):
    from framescore.functions.codec import encode_features
    from framescore.sources.csv import render_csv_line
    df = spark.createDataFrame([([1.0, None, 3.0], 9), ([1.0, 2.0, 3.0], None), (None, 1)],
                               "f array<float>, id int").coalesce(1)
    lines = [r[0] for r in df.select(render_csv_line("f", "id")).collect()]
    assert lines == ["1.0,,3.0,9", "1.0,2.0,3.0,", None]
    got = parse_features(spark.createDataFrame([(x,) for x in lines], "value string"), 3).collect()
    assert [r["reject_reason"] for r in got] == ["bad_number", None, "null_row"]
    sent = [r[0] for r in df.select(encode_features("f")).collect()]
    assert sent[0] is None and sent[1] == struct.pack(">3f", 1, 2, 3) and sent[2] is None


def test_idx_writer_names_what_it_cannot_hold(spark, scratch):
    import pytest
    df = spark.createDataFrame([(1, b"\x00" * 4, 256)], "k int, px binary, y int")
    with pytest.raises(ValueError, match="labels 0-255"):
        write_idx_pair(df, os.path.join(scratch, "idx"), "px", "y", 2, 2)


def test_limit_zero_is_no_rows(spark, scratch):
    from framescore.sinks.results import read_results
    path = os.path.join(scratch, "t")
    spark.range(3).selectExpr("id AS offset", "0 AS partition").write.parquet(path)
    assert read_results(spark, path, limit=0).count() == 0
    assert read_results(spark, path).count() == 3


def test_shared_folder_is_required_off_local():
    import pytest

    from framescore.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_workers_find_the_package_from_any_folder(scratch):
    """Only the driver's path names the package; the workers get it by addPyFile."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from framescore.session import get_session\n"
            "s = get_session('local[2]', shuffle_partitions=2)\n"
            "import __spark_entry__ as e\n"
            "print('ROWS', e.queries()['score_dense'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=scratch, env=env, capture_output=True, text=True,
                       timeout=300)
    assert "ROWS 500" in r.stdout, r.stderr[-2000:]
