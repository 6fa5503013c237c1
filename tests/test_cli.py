import os

from pyspark.sql import functions as F

from framescore.plans import cli
from framescore.sources.csv import render_csv_line
from framescore.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_publish_then_score_stream(spark, scratch):
    csv = os.path.join(scratch, "csv")
    table(spark, SF, "embeddings").select(
        render_csv_line("embedding", "label").alias("value")).write.text(csv)
    log = os.path.join(scratch, "log")
    cli.main(["publish", "--csv", csv, "--width", "64", "--topic", "stair", "--outfile", log])
    recs = spark.read.parquet(log)
    assert recs.count() == 500
    # offsets are dense 0..n-1 within each partition
    stats = recs.groupBy("partition").agg(F.count(F.lit(1)).alias("n"),
                                          F.min("offset").alias("lo"), F.max("offset").alias("hi"),
                                          F.countDistinct("offset").alias("d"))
    for r in stats.collect():
        assert (r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"])
    out = os.path.join(scratch, "out")
    cli.main(["scored", "--source", "parquet", "--path", log, "--outfile", out,
              "--available-now", "--model", f"centroids:{SF}",
              "--checkpoint", os.path.join(scratch, "ck")])
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert len(lines) == 500 and all(len(x.split(" : ")) == 9 for x in lines)
    # the log's partitions are filled evenly although many send times are equal
    assert {r["n"] for r in stats.collect()} == {125}


def test_second_run_continues(spark, scratch):
    """No checkpoint given: a second run of the job reads only what came meanwhile."""
    from framescore.sinks.results import write_record_log
    from framescore.sources.tables import embedding_records
    log, out = os.path.join(scratch, "log"), os.path.join(scratch, "out")
    recs = embedding_records(spark, SF)
    args = ["keyvalue", "--source", "parquet", "--path", log + "/*", "--outfile", out, "--available-now",
            "--max-files-per-trigger", "2"]
    write_record_log(recs.where("offset < 50"), log + "/a")
    cli.main(args)
    assert spark.read.text(out).count() == 200
    write_record_log(recs.where("offset >= 50"), log + "/b")
    cli.main(args)
    lines = spark.read.text(out)
    assert lines.select(F.split("value", " ")[0]).distinct().count() == lines.count() == 500
    back = os.path.join(scratch, "back")
    cli.main(["results", "--source", "parquet", "--path", out, "--outfile", back, "--limit", "7"])
    assert spark.read.text(back).count() == 7


def test_publish_keeps_rejected_lines(spark, scratch):
    csv, log = os.path.join(scratch, "f.csv"), os.path.join(scratch, "log")
    with open(csv, "w") as f:
        f.write("1,2,3\n1,2\n1,x,3\n4,5,6\n")
    cli.main(["publish", "--csv", csv, "--width", "3", "--outfile", log])
    assert spark.read.parquet(log).count() == 2
    assert sorted(r["reject_reason"] for r in spark.read.parquet(log + "-rejects").collect()) == [
        "bad_number", "short_row"]
