"""K2/T1 one commit per micro-batch, L1 and J1 by position in the input, U1 lifecycle, launcher options."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescore.operators.evaluate import positional_accuracy
from framescore.operators.models import DenseSoftmax, fit_centroids
from framescore.operators.scoring import score
from framescore.plans import cli, jobs
from framescore.sinks.results import write_record_log
from framescore.sources.lines import first_lines, line_positions, zip_lines
from framescore.sources.tables import embedding_records, table
from framescore.streaming import commits, runner

SF = "/root/testdata/sf0.001"


def _odd_log(spark, scratch):
    log = os.path.join(scratch, "log")
    recs = embedding_records(spark, SF)
    write_record_log(recs.withColumn("value", F.when(F.col("offset") % 10 == 0, F.expr("substring(value, 1, 3)"))
                                     .otherwise(F.col("value"))), log, max_records_per_file=60)
    return log


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_crash_around_the_commit(spark, scratch, monkeypatch, where):
    """Lines are written and rejects are written; the driver dies before, or just after, the manifest."""
    out = os.path.join(scratch, "out")
    kw = dict(source="parquet", path=_odd_log(spark, scratch), outfile=out, available_now=True, max_files_per_trigger=4,
              checkpoint=os.path.join(scratch, "ck"))
    calls, commit = [], runner.commit

    def dying(*args, **kwargs):
        calls.append(args)
        if len(calls) == 2:
            if where == "after":
                commit(*args, **kwargs)
            raise RuntimeError("driver died")
        commit(*args, **kwargs)
    monkeypatch.setattr(runner, "commit", dying)
    with pytest.raises(Exception, match="driver died"):
        jobs.run_stream(spark, "keyvalue", spec=jobs.FLOAT_RECORDS, **kw)
    done = commits.manifests(out + "-commits")
    assert len(done) == (1 if where == "before" else 2)
    seen = commits.committed_lines(spark, out + "-commits").count() + commits.committed_rejects(spark, out + "-commits").count()
    assert seen == sum(m["records"] for m in done) < 500        # what the half batch wrote is not seen
    monkeypatch.setattr(runner, "commit", commit)
    jobs.run_stream(spark, "keyvalue", spec=jobs.FLOAT_RECORDS, **kw)
    lines, rejects = (f(spark, out + "-commits") for f in (commits.committed_lines, commits.committed_rejects))
    assert lines.count() == 448 and rejects.count() == 52
    assert lines.select(F.split("value", " ")[0]).distinct().count() == 448
    assert rejects.select("partition", "offset").distinct().count() == 52


def test_rejects_keep_the_record_and_counts_add_up(spark, scratch):
    out, log = os.path.join(scratch, "out"), _odd_log(spark, scratch)
    jobs.run_stream(spark, "scored", source="parquet", path=log, outfile=out, available_now=True, max_files_per_trigger=3,
                    model=fit_centroids(table(spark, SF, "embeddings"), "embedding", "label"),
                    measures={"top": F.max("label")})
    kept = commits.committed_rejects(spark, out + "-commits").collect()
    sent = {(r["partition"], r["offset"]): (r["key"], r["value"]) for r in spark.read.parquet(log).where("length(value) = 3").collect()}
    assert {(r["partition"], r["offset"]): (r["key"], r["value"]) for r in kept} == sent and len(kept) == 52
    told = commits.batches(spark, out + "-commits").collect()
    assert len(told) > 2 and sum(r["records"] for r in told) == 500 and sum(r["lines"] for r in told) == 448
    assert sum(r["rejects"].get("short_value", 0) for r in told) == 52 and max(r["measures"]["top"] for r in told) == 9
    empty = os.path.join(scratch, "none")
    assert commits.batches(spark, empty).count() == commits.committed_lines(spark, empty).count() == 0
    assert commits.committed_rejects(spark, empty).columns[-1] == "reject_reason"


# ---------------------------------------------------------------- positions

def _files(scratch, n, lines):
    folder = os.path.join(scratch, "text")
    os.makedirs(folder)
    for k in range(n):
        with open(os.path.join(folder, f"part-{k}.txt"), "w") as f:
            f.writelines(f"{k}-{i}-{'x' * (i % 40)}\n" if i % 7 else "\n" for i in range(lines))
    return folder


def test_positions_follow_files_and_lines(spark, scratch):
    folder = _files(scratch, 12, 300)                            # part-2 comes before part-10
    want = [f"{k}-{i}-{'x' * (i % 40)}" if i % 7 else "" for k in range(12) for i in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits a file
    try:
        got = line_positions(spark, folder)
        assert [r["value"] for r in sorted(got.collect(), key=lambda r: r["pos"])] == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan
        for n in (0, 1, 299, 301, 3000, 9999):
            first = sorted((r["pos"], r["value"]) for r in first_lines(spark, folder, n).collect())
            assert first == list(enumerate(want))[:n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_lines_leaves_later_files_unread(spark, scratch):
    folder = _files(scratch, 12, 300)
    with open(os.path.join(folder, "part-11.txt"), "wb") as f:
        f.write(b"unread")
    os.chmod(os.path.join(folder, "part-11.txt"), 0)
    plan = first_lines(spark, folder, 500)
    assert plan.count() == 500


def test_zip_reports_what_is_left_over(spark):
    left = spark.createDataFrame([(i, i % 3) for i in range(10)], "pos bigint, label int")
    right = spark.createDataFrame([(i, i % 3 if i != 4 else 9) for i in range(7)], "pos bigint, label int")
    r = positional_accuracy(zip_lines(left, right)).first()
    assert (r["n"], r["n_correct"], r["only_left"], r["only_right"]) == (7, 6, 3, 0) and abs(r["accuracy"] - 6 / 7) < 1e-12
    r = positional_accuracy(zip_lines(right.limit(0), right)).first()
    assert (r["n"], r["accuracy"], r["only_right"]) == (0, None, 7)


# ---------------------------------------------------------------- scorer lifecycle

@pytest.mark.parametrize("fail", [False, True])
def test_sessions_are_closed(spark, scratch, fail):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "jobs", "counting_model.py"))
    from counting_model import Sessions
    df = spark.range(0, 1000, 1, 5).select(F.array(F.col("id").cast("float"), F.lit(0).cast("float")).alias("features"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        scored = score(df, Sessions(scratch, fail), timings=False)
        if fail:
            with pytest.raises(Exception, match="session broke"):
                scored.select("label").collect()
        else:
            assert len(scored.select("label").collect()) == 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    names = [n.split("-")[0] for n in os.listdir(scratch)]
    assert names.count("open") == names.count("close") >= (1 if fail else 5)
    assert fail or names.count("open") == 5                       # one session a task, not one a batch


# ---------------------------------------------------------------- launcher

def test_results_limit_keeps_input_order(spark, scratch):
    folder, out = _files(scratch, 11, 50), os.path.join(scratch, "out")
    cli.main(["results", "--source", "parquet", "--path", folder, "--outfile", out, "--limit", "120"])
    want = [f"{k}-{i}-{'x' * (i % 40)}" if i % 7 else "" for k in range(3) for i in range(50)][:120]
    assert sorted(r[0] for r in spark.read.text(out).collect()) == sorted(want)


def test_launcher_defaults(spark, scratch, monkeypatch):
    """The pass-through measures its decode time unless told not to; float32 keeps a model's labels."""
    log, out = os.path.join(scratch, "log"), os.path.join(scratch, "out")
    write_record_log(embedding_records(spark, SF), log)
    cli.main(["passthrough", "--source", "parquet", "--path", log, "--outfile", out, "--available-now"])
    assert all(int(r[0].split(" : ")[2]) > 0 for r in spark.read.text(out).collect())
    sparse = DenseSoftmax(np.eye(3, 64), labels=[40, 7, 99])
    monkeypatch.setattr(cli, "_model", lambda *a: sparse)
    out = os.path.join(scratch, "out32")
    cli.main(["scored", "--source", "parquet", "--path", log, "--outfile", out, "--available-now", "--float32", "--model", "x"])
    assert {r[0].split(" : ")[8] for r in spark.read.text(out).collect()} == {"40", "7", "99"}


def test_launcher_on_committed_logs(spark, scratch):
    csv, log, back = (os.path.join(scratch, n) for n in ("f.csv", "log", "back"))
    with open(csv, "w") as f:
        f.write("".join(f"{i},{i + 1}\n" for i in range(40)) + "bad\n")
    cli.main(["publish", "--csv", csv, "--width", "2", "--outlog", log, "--partitions", "3"])
    cli.main(["passthrough", "--source", "log", "--path", log, "--outlog", back, "--available-now", "--starting-offsets",
              json.dumps({"0": 2}), "--max-offsets-per-trigger", "9", "--min-partitions", "4"])
    from framescore.sources.record_log import latest_offsets
    assert sum(latest_offsets(log).values()) == 40 and sum(latest_offsets(back).values()) == 38
