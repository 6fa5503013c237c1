"""The committed record log read and written by offsets."""

import os
import struct

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from framescore.plans import jobs
from framescore.sources import record_log as rl
from framescore.sources.tables import KEY_BASE_MS, embedding_records

SF = "/root/testdata/sf0.001"


def _log(spark, scratch, name="log"):
    path = os.path.join(scratch, name)
    rl.write_log(embedding_records(spark, SF).drop("offset").orderBy("timestamp"), path, topic="stair")
    return path


def _run(spark, log, checkpoint, name, batches=None, **options):
    """Stream into memory; the rows (partition, offset) of each micro-batch."""
    seen = []

    def keep(df, batch):
        seen.append(sorted((r["partition"], r["offset"]) for r in df.select("partition", "offset").collect()))
        if batches and len(seen) >= batches:
            raise RuntimeError("stop here")
    q = (rl.read_log(spark, log, streaming=True, **options).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(keep).start())
    try:
        q.processAllAvailable()
    except Exception:                                     # noqa: BLE001 - the stop above
        if not batches:
            raise
    finally:
        q.stop()
    return seen


def test_offsets_are_dense_and_in_write_order(spark, scratch):
    log = _log(spark, scratch)
    rows = rl.read_log(spark, log).select("partition", "offset", F.col("key").cast("string").cast("bigint").alias("k"),
                                          F.length("value").alias("n"), "topic").collect()
    assert len(rows) == 500 and {r["n"] for r in rows} == {256} and {r["topic"] for r in rows} == {"stair"}
    assert all((r["k"] - KEY_BASE_MS) // 4 == r["offset"] and (r["k"] - KEY_BASE_MS) % 4 == r["partition"] for r in rows)
    rl.write_log(spark.createDataFrame([(b"k", b"v", 2)], "key binary, value binary, partition int"), log)
    assert rl.latest_offsets(log) == {0: 125, 1: 125, 2: 126, 3: 125}
    last = rl.read_log(spark, log, starting_offsets={0: 125, 1: 125, 2: 125, 3: 125}).collect()
    assert [(r["partition"], r["offset"], r["value"]) for r in last] == [(2, 125, b"v")]


def test_batch_reading_between_offsets(spark, scratch):
    log = _log(spark, scratch)
    got = rl.read_log(spark, log, starting_offsets={0: 100, 1: 7}, ending_offsets={1: 9, 3: 1}, min_partitions=40)
    assert {(r["partition"], r["n"], r["lo"]) for r in got.groupBy("partition").agg(
        F.count("*").alias("n"), F.min("offset").alias("lo")).collect()} == {(0, 25, 100), (1, 2, 7), (2, 125, 0), (3, 1, 0)}


def test_hot_partition_is_cut():
    cut = rl.slices("log", {0: [("a", 0, 900, 0), ("b", 10, 50, 900)], 1: [("c", 5, 50, 20)]}, 10)
    assert sum(n for s in cut for _, _, n, _ in s.pieces) == 1000 and max(sum(n for _, _, n, _ in s.pieces) for s in cut) == 100
    assert len([s for s in cut if s.partition == 0]) == 10
    assert cut[9].pieces == [("b", 10, 50, 900)] and cut[8].pieces == [("a", 800, 100, 800)]
    assert len(rl.slices("log", {0: [("a", 0, 900, 0)], 1: [("c", 5, 50, 20)]}, None)) == 2


@pytest.mark.parametrize("most", [1, 3, 7, 50, 1000])
def test_deal_never_stops_and_never_overruns(most):
    start, end = {0: 5, 1: 0}, {0: 5, 1: 90, 2: 13, 3: 1}
    steps = 0
    while any(start.get(p, 0) < e for p, e in end.items()):
        nxt = rl.deal(start, end, most)
        moved = sum(nxt[p] - start.get(p, 0) for p in end)
        assert 0 < moved <= most and all(start.get(p, 0) <= nxt[p] <= end[p] for p in end)
        start, steps = nxt, steps + 1
    assert start == end and steps <= 104


def test_stream_from_offsets_in_bounded_batches_and_restart(spark, scratch):
    log, ck = _log(spark, scratch), os.path.join(scratch, "ck")
    how = dict(starting_offsets={0: 100, 2: 3}, max_offsets_per_trigger=90, min_partitions=3, group="g",
               progress=os.path.join(scratch, "planned"))
    first = _run(spark, log, ck, "a", batches=2, **how)         # fails in its second micro-batch
    again = _run(spark, log, ck, "b", **how)
    assert again[0] == first[1]                                # which is done again, with the same offsets
    done = [r for batch in first[:1] + again for r in batch]
    want = sorted((p, o) for p in range(4) for o in range(125) if o >= {0: 100, 2: 3}.get(p, 0))
    assert sorted(done) == want and max(len(b) for b in first + again) == 90
    rl.write_log(spark.createDataFrame([(b"k", b"v", 1)] * 5, "key binary, value binary, partition int"), log)
    assert _run(spark, log, ck, "c", **how) == [[(1, 125 + i) for i in range(5)]]
    assert rl.group_offsets(log, "g") is not None and rl.group_offsets(log, "other") is None


def test_group_goes_on_without_a_checkpoint(spark, scratch):
    """A second query of the group, with a checkpoint of its own, starts where the first one's commit ended."""
    log = _log(spark, scratch)
    _run(spark, log, os.path.join(scratch, "ck1"), "a", starting_offsets="earliest", group="g", max_offsets_per_trigger=200,
         progress=os.path.join(scratch, "p1"))
    done = rl.group_offsets(log, "g")
    assert 0 < sum(done.values()) <= 500
    rest = [r for b in _run(spark, log, os.path.join(scratch, "ck2"), "b", group="g") for r in b]
    assert sorted(rest) == sorted((p, o) for p in range(4) for o in range(done[p], 125))
    assert _run(spark, log, os.path.join(scratch, "ck3"), "c", group="new") in ([], [[]])     # no progress: the latest


def test_a_failing_task_leaves_no_half_batch(spark, scratch):
    log = _log(spark, scratch)
    before = rl.latest_offsets(log)
    bad = spark.range(0, 4000, 1, 4).select(
        F.col("id").cast("string").cast("binary").alias("key"),
        F.when(F.col("id") == 3999, F.raise_error(F.lit("broken record"))).otherwise(F.lit("x")).cast("binary").alias("value"))
    with pytest.raises(Exception, match="broken record"):
        rl.write_log(bad, log)
    assert rl.latest_offsets(log) == before and rl.read_log(spark, log).count() == 500


def test_a_retried_batch_commits_once(spark, scratch):
    log = os.path.join(scratch, "once")
    df = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"))
    for _ in range(3):
        rl.write_log(df, log, writer="job", batch=4)
    assert sum(rl.latest_offsets(log).values()) == 100
    fs, folder = pafs.LocalFileSystem(), os.path.join(log, "segments")
    kept = {s["file"] for m in rl.Manifests(log).all() for s in m["segments"]}
    assert {f.base_name for f in fs.get_file_info(pafs.FileSelector(folder))} == kept      # nothing left lying about


def test_stream_writer(spark, scratch):
    log, back = _log(spark, scratch), os.path.join(scratch, "back")
    rl.register(spark)
    lines = rl.read_log(spark, log, streaming=True, starting_offsets="earliest", max_offsets_per_trigger=120,
                        progress=os.path.join(scratch, "p"))
    w = lines.select("key", "value", "partition", "topic", "timestamp", "timestampType").writeStream.format(rl.FORMAT)
    q = w.option("path", back).option("writer", "copy").option("checkpointLocation", os.path.join(scratch, "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert len(rl.Manifests(back).all()) == 5 and rl.latest_offsets(back) == rl.latest_offsets(log)
    cols = ("partition", "key", "value")
    assert sorted(tuple(r[c] for c in cols) for r in rl.read_log(spark, back).collect()) == sorted(
        tuple(r[c] for c in cols) for r in rl.read_log(spark, log).collect())


def test_keyless_and_null_records(spark, scratch):
    log = os.path.join(scratch, "odd")
    df = spark.createDataFrame([(None, b"a"), (None, None), (b"k", None), (b"k", b""), (b"k", b"z")], "key binary, value binary")
    rl.write_log(df.coalesce(1), log, partitions=3)
    rows = rl.read_log(spark, log).collect()
    assert sorted((r["key"] or b"", r["value"] or b"") for r in rows) == [(b"", b""), (b"", b"a"), (b"k", b""), (b"k", b""), (b"k", b"z")]
    assert len({r["partition"] for r in rows if r["key"] == b"k"}) == 1
    rl.write_log(df.limit(0), log)
    assert sum(rl.latest_offsets(log).values()) == 5
    with pytest.raises(Exception, match="progress"):
        _run(spark, log, os.path.join(scratch, "ck"), "x", max_offsets_per_trigger=2)


def test_job_on_a_log_writes_a_log(spark, scratch):
    """Get.java's job without a broker: topic in, ``-return`` lines out, a second run goes on."""
    log, back = _log(spark, scratch), os.path.join(scratch, "return")
    kw = dict(source="log", path=log, topic="stair", outlog=back, available_now=True, starting_offsets="earliest",
              max_offsets_per_trigger=200)
    jobs.run_stream(spark, "passthrough", **kw)
    rl.write_log(spark.createDataFrame([(b"7", struct.pack(">2f", 1.5, 2), 1)], "key binary, value binary, partition int"),
                 log, topic="stair")
    jobs.run_stream(spark, "passthrough", **kw)
    lines = [r[0].split(" : ") for r in rl.read_log(spark, back).select(F.col("value").cast("string")).collect()]
    assert len(lines) == 501 and sum(f[0] == "7" and f[4:] == ["1", "125", "1.5"] for f in lines) == 1
    assert len({(f[4], f[5]) for f in lines}) == 501
