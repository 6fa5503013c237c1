import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from framescore.operators.models import fit_centroids
from framescore.operators.offsets import assign_offsets
from framescore.plans import catalog, jobs
from framescore.sinks.results import write_record_log
from framescore.sources.tables import embedding_records, table
from framescore.streaming.commits import manifests
from framescore.streaming.runner import run_to_end, start_stream, trigger_args

SF = "/root/testdata/sf0.001"


def _window_offsets(df, p):
    w = Window.partitionBy(p).orderBy("event_id")
    return {r[0]: r[1] for r in df.select("event_id", (F.row_number().over(w) - 1).alias("o"))
            .collect()}


def test_assign_offsets_equals_window_rank(spark):
    ev = table(spark, SF, "events").withColumn("p", (F.col("user_id") % 4).cast("int"))
    got = {r[0]: r[1] for r in assign_offsets(ev, "p", ["event_id"], num_ranges=6)
           .select("event_id", "offset").collect()}
    assert got == _window_offsets(ev, "p")


def test_assign_offsets_one_hot_partition(spark):
    """All rows in one topic partition: the work still spreads over all ranges."""
    ev = table(spark, SF, "events").withColumn("p", F.lit(0))
    out = assign_offsets(ev, "p", ["event_id"], num_ranges=8)
    got = {r[0]: r[1] for r in out.select("event_id", "offset").collect()}
    assert got == _window_offsets(ev, "p")
    assert sorted(got.values()) == list(range(ev.count()))


def test_trigger_args():
    assert trigger_args(5) == {"processingTime": "5 milliseconds"}
    assert trigger_args(None, available_now=True) == {"availableNow": True}
    assert trigger_args() == {}


def _log(spark, scratch, name, lo, hi):
    recs = embedding_records(spark, SF)
    part = recs.where((F.col("offset") >= lo) & (F.col("offset") < hi))
    write_record_log(part, os.path.join(scratch, "log", name))


def test_stream_replay_restart_and_new_files(spark, scratch):
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")
    log = os.path.join(scratch, "log")
    out = os.path.join(scratch, "out")
    ckpt = os.path.join(scratch, "ckpt")
    _log(spark, scratch, "a", 0, 60)
    kw = dict(source="parquet", path=log + "/*", topic="stair", outfile=out,
              available_now=True, model=m, checkpoint=ckpt, wait_timeout_s=300)
    jobs.run_stream(spark, jobs.scored, **kw)
    n1 = spark.read.text(out).count()
    assert n1 == 240
    jobs.run_stream(spark, jobs.scored, **kw)              # restart: nothing new
    assert spark.read.text(out).count() == n1
    _log(spark, scratch, "b", 60, 125)                      # a later drop
    jobs.run_stream(spark, jobs.scored, **kw)
    lines = spark.read.text(out)
    assert lines.count() == 500 and lines.distinct().count() == 500


def test_stream_equals_batch(spark, scratch):
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")
    log = os.path.join(scratch, "log2")
    write_record_log(embedding_records(spark, SF), log)
    stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    q = start_stream(jobs.scored(stream, m).select("send_time", "label"), "memory",
                     os.path.join(scratch, "ck2"), query_name="scored_mem", available_now=True)
    run_to_end(q, 300)
    streamed = {tuple(r) for r in spark.sql("SELECT send_time, label FROM scored_mem").collect()}
    batch = {tuple(r) for r in jobs.scored(spark.read.parquet(log), m)
             .select("send_time", "label").collect()}
    assert streamed == batch and len(batch) == 500


def test_overwrite_text_sink_is_idempotent(spark, scratch):
    log = os.path.join(scratch, "log3")
    write_record_log(embedding_records(spark, SF), log)
    stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    out = os.path.join(scratch, "ow")
    q = start_stream(jobs.passthrough(stream), "overwrite-text", os.path.join(scratch, "ck3"),
                     path=out, available_now=True)
    run_to_end(q, 300)
    lines = spark.read.text(out)
    assert lines.count() == 500
    assert lines.where(F.size(F.split("value", " : ")) != 7).count() == 0


def test_stream_rejects_are_kept_with_reason(spark, scratch):
    import struct
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")
    log = os.path.join(scratch, "log4")
    recs = embedding_records(spark, SF)
    bad = spark.createDataFrame(
        [(None, struct.pack(">64f", *([0.5] * 64)), 0, 900), (b"1", None, 1, 900),
         (b"2", b"\x01\x02", 2, 900), (b"3", struct.pack(">3f", 1, 2, 3), 3, 900)],
        "key binary, value binary, partition int, offset long")
    bad = bad.selectExpr("key", "value", "'stair' AS topic", "partition", "offset",
                         "current_timestamp() AS timestamp", "0 AS timestampType")
    write_record_log(recs.unionByName(bad), log)
    out, rej = os.path.join(scratch, "out4"), os.path.join(scratch, "rej4")
    jobs.run_stream(spark, jobs.scored, source="parquet", path=log, outfile=out,
                    rejects_path=rej, available_now=True, model=m,
                    checkpoint=os.path.join(scratch, "ck4"), wait_timeout_s=300)
    assert spark.read.text(out).count() == 500
    reasons = sorted(r[0] for r in spark.read.parquet(rej).select("reject_reason").collect())
    assert reasons == ["bad_width", "null_key", "null_value", "short_value"]


def test_processing_time_trigger(spark, scratch):
    """The latency knob maps to a processing-time trigger."""
    log = os.path.join(scratch, "log5")
    write_record_log(embedding_records(spark, SF), log)
    stream = spark.readStream.schema(spark.read.parquet(log).schema).option(
        "maxFilesPerTrigger", "1").parquet(log)
    q = start_stream(jobs.keyvalue(stream, keep=["partition", "offset"]), "memory",
                     os.path.join(scratch, "ck5"), query_name="kv_mem", timeout_ms=50)
    try:
        q.processAllAvailable()
        rows = spark.sql("SELECT value FROM kv_mem").collect()
    finally:
        q.stop()
    assert len(rows) == 500 and all(len(r[0].split(" ")) == 4 for r in rows)


def test_fresh_run_into_old_output_needs_overwrite(spark, scratch):
    import pytest
    m = fit_centroids(table(spark, SF, "embeddings"), "embedding", "label")
    log = os.path.join(scratch, "log6")
    write_record_log(embedding_records(spark, SF), log)
    out = os.path.join(scratch, "out6")
    kw = dict(source="parquet", path=log, outfile=out, available_now=True, model=m,
              wait_timeout_s=300)
    jobs.run_stream(spark, jobs.scored, **kw)
    jobs.run_stream(spark, jobs.scored, **kw)              # the same job goes on: nothing new
    assert spark.read.text(out).count() == 500
    with pytest.raises(FileExistsError):                   # another job into the same place
        jobs.run_stream(spark, "keyvalue", **{**kw, "model": None})
    jobs.run_stream(spark, jobs.scored, overwrite=True, **kw)
    assert spark.read.text(out).count() == 500


def test_replay_bounded_by_bytes(spark, scratch):
    log = os.path.join(scratch, "log7")
    write_record_log(embedding_records(spark, SF), log, max_records_per_file=50)
    from framescore.sources.records import record_stream
    s = record_stream(spark, "parquet", path=log, max_bytes_per_trigger=20000)
    q = start_stream(s, "memory", os.path.join(scratch, "ck7"), query_name="mb7",
                     available_now=True)
    run_to_end(q, 300)
    assert spark.sql("SELECT count(*) FROM mb7").first()[0] == 500
    assert len(q.recentProgress) > 1


def test_assign_offsets_keeps_null_partition_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 0), (4, None), (5, 1)],
                               "event_id long, p int")
    got = {r["event_id"]: r["offset"] for r in assign_offsets(df, "p", ["event_id"], num_ranges=3).collect()}
    assert got == {1: 0, 3: 1, 2: 0, 4: 1, 5: 0}


def test_offsets_do_not_shuffle_the_log_twice(spark):
    """With the smallest broadcast threshold the shift table is still broadcast: the only
    exchange of the log is the range one, which is written before."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        ev = table(spark, SF, "events").withColumn("p", (F.col("user_id") % 4).cast("int"))
        out = assign_offsets(ev, "p", ["event_id"], num_ranges=6)
        n = out.count()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert n == ev.count() and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_rejects_are_kept_by_default_and_strict_fails(spark, scratch):
    import pytest
    log = os.path.join(scratch, "log8")
    rows = [(b"1", b"\x01", 0, 0), (b"2", b"", 0, 1), (None, b"\x02\x03", 0, 2), (b"3", b"\xff\x00\x01", 0, 3)]
    df = spark.createDataFrame(rows, "key binary, value binary, partition int, offset long").selectExpr(
        "key", "value", "'t' AS topic", "partition", "offset", "current_timestamp() AS timestamp",
        "0 AS timestampType")
    write_record_log(df, log)
    out = os.path.join(scratch, "out8")
    kw = dict(source="parquet", path=log, available_now=True, wait_timeout_s=300)
    jobs.run_stream(spark, "keyvalue", outfile=out, **kw)
    assert sorted(r[0].split(" ")[3] for r in spark.read.text(out).collect()) == ["-1", "1"]
    kept = {r["offset"]: r["reject_reason"] for r in spark.read.parquet(out + "-rejects").collect()}
    assert kept == {1: "short_value", 2: "null_key"}
    with pytest.raises(Exception, match="bad record"):
        jobs.run_stream(spark, "keyvalue", outfile=os.path.join(scratch, "out9"), strict=True, **kw)


def test_a_long_log_is_replayed_in_a_bounded_number_of_batches(spark, scratch, monkeypatch):
    """Batches grow with the log, not their number; every record still has its line or its reason."""
    n = 20_000
    spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('x', id) END AS text").write.parquet(
        os.path.join(scratch, "documents.parquet"))
    ran, run_stream = [], catalog.jobs.run_stream
    monkeypatch.setattr(catalog.jobs, "run_stream", lambda *a, **kw: (ran.append(kw["outfile"]), run_stream(*a, **kw)))
    got = catalog.stream_keyvalue_q(spark, scratch)
    assert got.select("doc_id").distinct().count() == got.count() == n
    assert got.where("reject_reason = 'null_value'").count() == len(range(0, n, 7))
    done = manifests(ran[0] + "-commits")
    assert 1 < len(done) <= catalog.REPLAY_BATCHES and sum(m["records"] for m in done) == n


def test_files_and_batches_grow_with_a_log():
    assert catalog._file_rows(10_000) == catalog.RECORD_LOG_FILE_ROWS
    for records in (100_000, 3_000_000, 1_000_000_000):
        assert -(-records // catalog._file_rows(records)) <= catalog.LOG_FILES
