"""Command-line launcher with the original run parameters.

    python -m framescore.plans.cli JOB [--topic T] [--outfile P] [--timeout MS] ...

JOB: passthrough | keyvalue | scored | images | publish | results
  --topic      source topic (default ``stair``; on replay: every topic of the log); results
               go to ``<topic>-return`` unless --outfile is given
  --rejects    where malformed records go (default: beside the output); --strict fails instead
  --outfile    write result lines as text files instead of the return topic
  --timeout    trigger interval in milliseconds (latency knob); default trigger if unset
  --source     ``kafka``, ``parquet`` (replayed record files at --path) or ``log`` (a committed record
               log at --path, read by offsets: --starting-offsets, --group, --max-offsets-per-trigger)
  --outlog     write result lines (publish: records) as a committed record log
  --model      ``centroids:<sf_dir>`` | ``lstm[:seed]`` | ``onnx:<file>:<width>:<classes>``
publish: --csv <path> --width N writes keyed float32 records to the topic (or --outfile
         as a parquet record log); rejected lines go to --rejects.
results: the result lines of --topic (or of the text files at --path), written to --outfile.
A second run of a job goes on where the first stopped; --overwrite starts over.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):          # run as a script file (spark-submit .../cli.py)
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from framescore.operators.rejects import BYTE_RECORDS, FLOAT_RECORDS, IMAGE_RECORDS  # noqa: E402
from framescore.session import drop_derived, get_session  # noqa: E402
from framescore.sources.records import DEFAULT_TOPIC  # noqa: E402


def _model(spark, spec: str | None):
    if not spec:
        return None
    kind, _, rest = spec.partition(":")
    if kind == "centroids":
        from framescore.plans.catalog import dense_model
        return dense_model(spark, rest)
    if kind == "lstm":
        from framescore.operators.models import LstmSoftmax
        return LstmSoftmax.seeded(seed=int(rest) if rest else 7)
    if kind == "onnx":
        from framescore.operators.models import ship_model_file
        path, width, classes = rest.rsplit(":", 2)
        return ship_model_file(spark, path, int(width), int(classes))
    raise SystemExit(f"unknown model spec {spec!r}")


def main(argv=None):
    ap = argparse.ArgumentParser(prog="framescore")
    ap.add_argument("job", choices=["passthrough", "keyvalue", "scored", "images", "publish", "results"])
    ap.add_argument("--topic", help=f"default {DEFAULT_TOPIC}; a replayed log is read whole without it")
    ap.add_argument("--outfile")
    ap.add_argument("--timeout", type=int)
    ap.add_argument("--source", default="kafka", choices=["kafka", "parquet", "log"])
    ap.add_argument("--outlog", help="a committed record log for the results, or for published records")
    ap.add_argument("--starting-offsets", help="earliest, latest or JSON {partition: offset}")
    ap.add_argument("--group", help="log: consumer group whose progress is kept (default: the topic)")
    ap.add_argument("--path")
    ap.add_argument("--bootstrap", default="localhost:9092")
    ap.add_argument("--checkpoint")
    ap.add_argument("--model")
    ap.add_argument("--available-now", action="store_true")
    ap.add_argument("--earliest", action="store_true")
    ap.add_argument("--csv")
    ap.add_argument("--width", type=int, default=500)
    ap.add_argument("--divisor", type=float, default=225.0)
    ap.add_argument("--partitions", type=int, default=4)
    ap.add_argument("--overwrite", action="store_true",
                    help="replace an earlier fresh run's --outfile")
    ap.add_argument("--max-bytes-per-trigger", type=int,
                    help="replay: bound each micro-batch by input bytes")
    ap.add_argument("--max-files-per-trigger", type=int,
                    help="replay: bound each micro-batch by files")
    ap.add_argument("--min-partitions", type=int,
                    help="kafka, log: cut hot topic partitions into at least this many read tasks")
    ap.add_argument("--rejects")
    ap.add_argument("--strict", action="store_true", help="fail on the first malformed record")
    ap.add_argument("--limit", type=int, help="results: the first N lines, in the order of files and lines")
    ap.add_argument("--max-offsets-per-trigger", type=int,
                    help="kafka, log: bound each micro-batch by records")
    ap.add_argument("--float32", action="store_true",
                    help="dense models: float32 arithmetic (original precision, faster)")
    ap.add_argument("--timed", action=argparse.BooleanOptionalAction, default=True,
                    help="passthrough: decode whole payloads and measure decode time")
    a = ap.parse_args(argv)

    spark = get_session(app=f"framescore-{a.job}")
    from framescore.plans import jobs
    from framescore.sinks.results import read_return_topic, write_text

    if a.job == "publish":
        from pyspark.sql import functions as F

        from framescore.sinks.results import publish_kafka, write_record_log
        from framescore.sources.csv import feature_csv
        from framescore.sources.record_log import write_log
        rows = feature_csv(spark, a.csv, a.width)
        if a.strict:
            rows = rows.withColumn("features", F.when(F.col("reject_reason").isNull(), F.col("features"))
                                   .otherwise(F.raise_error(F.concat(F.lit("bad line: "), "reject_reason"))))
        else:
            (rows.where(F.col("reject_reason").isNotNull()).select("value", "reject_reason")
             .write.mode("overwrite").parquet(a.rejects or (a.outfile or a.outlog or a.csv).rstrip("/") + "-rejects"))
        recs = jobs.publish(rows.where(F.col("reject_reason").isNull()), "features", a.topic or DEFAULT_TOPIC)
        if a.outlog:
            write_log(recs, a.outlog, partitions=a.partitions)
        elif a.outfile:
            write_record_log(jobs.as_replay_log(recs, a.partitions), a.outfile)
        else:
            publish_kafka(recs, a.topic or DEFAULT_TOPIC, a.bootstrap)
        drop_derived(spark)
        return
    if a.job == "results":
        from framescore.sources.lines import first_lines
        if a.source == "kafka":
            out = read_return_topic(spark, a.topic or DEFAULT_TOPIC, a.bootstrap, a.limit)
        else:
            out = spark.read.text(a.path) if a.limit is None else first_lines(spark, a.path, a.limit).sort("pos")
        write_text(out, a.outfile)
        return

    model = _model(spark, a.model)
    if a.float32 and hasattr(model, "weights"):
        import numpy as np

        from framescore.operators.models import DenseSoftmax
        model = DenseSoftmax(model.weights, model.bias, name=model.name, dtype=np.float32,
                             labels=model.labels)
    job = {"passthrough": lambda r: jobs.passthrough(r, timed=a.timed),
           "keyvalue": jobs.keyvalue, "scored": jobs.scored,
           "images": lambda r, m: jobs.bare_labels(r, m, a.divisor)}[a.job]
    jobs.run_stream(spark, job, source=a.source, path=a.path, topic=a.topic,
                    bootstrap=a.bootstrap, outfile=a.outfile, outlog=a.outlog, group=a.group, timeout_ms=a.timeout,
                    available_now=a.available_now, checkpoint=a.checkpoint, model=model,
                    starting_offsets=a.starting_offsets or ("earliest" if a.earliest else None),
                    overwrite=a.overwrite, max_bytes_per_trigger=a.max_bytes_per_trigger,
                    max_offsets_per_trigger=a.max_offsets_per_trigger,
                    max_files_per_trigger=a.max_files_per_trigger, min_partitions=a.min_partitions,
                    rejects_path=a.rejects, strict=a.strict, job_name=a.job,
                    spec={"keyvalue": BYTE_RECORDS, "images": IMAGE_RECORDS}.get(a.job, FLOAT_RECORDS))
    drop_derived(spark)


if __name__ == "__main__":
    main()
