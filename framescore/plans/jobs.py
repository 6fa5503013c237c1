"""The original programs as DataFrame pipelines (same code for batch and stream).

=================  ==========================================================
``passthrough``    no model: decode, report the first feature (7-field line)
``keyvalue``       key/value records: first byte, signed (4-field line)
``scored``         decode -> model -> class (9-field line); dense NN or LSTM
``bare_labels``    image bytes / divisor -> model -> class text only
``csv_labels``     feature CSV -> model -> class table (batch)
``image_accuracy`` IDX images + labels -> model -> accuracy (batch)
``publish``        feature table/CSV -> keyed binary records (producer)
``run_stream``     source -> job -> sink as a streaming query (T1-T5, U4)
=================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.functions.codec import (clock_key, decode_timed, encode_features,
                                        first_byte_timed, first_feature, float_text, send_time)
from framescore.functions.trace import return_topic_name, trace_line
from framescore.operators.evaluate import accuracy
from framescore.operators.offsets import assign_offsets
from framescore.operators.rejects import (BYTE_RECORDS, FLOAT_RECORDS, IMAGE_RECORDS, REASON,
                                          RejectSpec, tag_rejects)
from framescore.operators.scoring import score
from framescore.session import delete_path, materialize, path_exists, stable_path
from framescore.sources.csv import feature_csv
from framescore.sources.idx import idx_images, idx_labels
from framescore.sources.record_log import latest_offsets
from framescore.sources.records import DEFAULT_TOPIC, publish_records, record_stream
from framescore.streaming.runner import drain, run_to_end, start_split


def _clock_ms():
    return F.unix_millis(F.current_timestamp())


def passthrough(records: DataFrame, keep: list | None = None, timed: bool = True) -> DataFrame:
    """R7 + line: whole payloads are decoded in one Arrow pass, and start, end and decode
    time are measured per batch, as the original did.  ``timed=False`` reads the first feature
    natively in Catalyst (nothing else is decoded, so no decode time exists: 0)."""
    if timed:
        t = records.select(*(keep or []), send_time("key").alias("send_time"), "partition",
                           "offset", decode_timed("value").alias("_fs_t"))
        out = t.select(*(keep or []), "send_time", F.col("_fs_t.start_ms").alias("start_ms"),
                       F.col("_fs_t.decode_ns").alias("decode_ns"),
                       F.col("_fs_t.end_ms").alias("end_ms"), "partition", "offset",
                       float_text(F.col("_fs_t.first")).alias("ans"))
        return out.withColumn("value", trace_line("passthrough"))
    out = records.select(
        *(keep or []),
        send_time("key").alias("send_time"), _clock_ms().alias("start_ms"),
        F.lit(0).cast("bigint").alias("decode_ns"), _clock_ms().alias("end_ms"),
        "partition", "offset", float_text(first_feature("value")).alias("ans"))
    return out.withColumn("value", trace_line("passthrough"))


def keyvalue(records: DataFrame, keep: list | None = None) -> DataFrame:
    """R4 + line (single-space layout); both clocks are read on the executor, before and
    after the batch's first bytes are taken."""
    t = records.select(*(keep or []), send_time("key").alias("send_time"),
                       first_byte_timed("value").alias("_fs_t"))
    out = t.select(*(keep or []), "send_time", F.col("_fs_t.start_ms").alias("start_ms"),
                   F.col("_fs_t.end_ms").alias("end_ms"), F.col("_fs_t.first").alias("first_byte"))
    return out.withColumn("value", trace_line("keyvalue"))


def scored(records: DataFrame, model, keep_extra: list | None = None) -> DataFrame:
    """R9 + line: payload decoded and scored in one Arrow pass."""
    keep = ["send_time", "partition", "offset", *(keep_extra or [])]
    r = records.select(send_time("key").alias("send_time"), "partition", "offset",
                       *(keep_extra or []), "value")
    s = score(r, model, features="value", keep=keep, input="f32be", with_scores=False)
    cols = ["send_time", "start_ms", "tensor_ns", "infer_ns", "post_ns", "end_ms",
            "partition", "offset", "label", *(keep_extra or [])]
    return s.select(*cols).withColumn("value", trace_line("scored"))


def bare_labels(records: DataFrame, model, divisor: float = 225.0,
                keep: list | None = None) -> DataFrame:
    """Image bytes scaled by ``divisor`` -> class as text ``value``."""
    keep = list(keep or [])
    s = score(records.select(*keep, "value"), model, features="value", keep=keep,
              input=("u8", divisor), timings=False, with_scores=False)
    return s.select(*keep, "label", F.col("label").cast("string").alias("value"))


def csv_labels(spark: SparkSession, path: str, model, width: int,
               key_field: int | None = None) -> DataFrame:
    """M5 (+S8): feature CSV -> class per row.  ``key_field`` (1-based past the features,
    or from the end if negative) names an extra column to carry along as ``key``.  Every
    line gives a row: a rejected one has its ``reject_reason`` and no class."""
    rows = feature_csv(spark, path, width, keep_fields=key_field is not None)
    if key_field is not None:
        rows = rows.select(F.try_element_at("_fs_fields", F.lit(key_field)).alias("key"), "features", REASON)
    else:
        rows = rows.select("value", "features", REASON)
    return score(rows, model, features="features", timings=False, with_scores=False)


def image_accuracy(spark: SparkSession, path: str, model, divisor: float = 255.0,
                   split_bytes: int | None = None) -> DataFrame:
    """M4 + J1 + A1: IDX images and labels -> predictions -> accuracy (``split_bytes``: large files are
    read in ranges by many tasks)."""
    imgs = idx_images(spark, path, split_bytes=split_bytes)
    preds = score(imgs.select("source", "pos", "pixels"), model, features="pixels",
                  keep=["source", "pos"], input=("u8", divisor), timings=False,
                  with_scores=False)
    return accuracy(preds, idx_labels(spark, path, split_bytes=split_bytes), ["source", "pos"])


def publish(df: DataFrame, features: str, topic: str, key=None, partition: str | None = None,
            offset: str | None = None, timestamp: str | None = None) -> DataFrame:
    """Producer: features -> (key = send-time text, value = float32 payload).  The send time
    is read for each record.  Partition and offset stay null unless given: a broker assigns
    them.  A vector that is null or has a null element has no payload (``value`` is null);
    the reading jobs reject it as ``null_value``."""
    key_col = clock_key(features) if key is None else (F.col(key) if isinstance(key, str) else key)
    staged = df.withColumn("_fs_key", key_col).withColumn("_fs_val", encode_features(features))
    return publish_records(staged, "_fs_key", "_fs_val", topic, partition, offset, timestamp)


def as_replay_log(records: DataFrame, partitions: int = 4) -> DataFrame:
    """Assign what a broker would for a replayable log.  Records are dealt round the
    partitions in arrival order (send times of a burst are equal, so a key's hash would
    fill one partition); offset = dense arrival rank within the partition.  The log is
    written once first, because a live send time differs each time it is read."""
    staged = materialize(records.drop("partition", "offset").withColumn(
        "_fs_seq", F.monotonically_increasing_id()), "replay-log")
    dealt = staged.withColumn("partition", F.pmod("_fs_seq", F.lit(partitions)).cast("int"))
    out = assign_offsets(dealt, "partition", ["key", "_fs_seq"])
    return out.drop("_fs_seq")


#: What each job can read of a record; a job that is not named reads keyed float payloads.
JOBS = {"passthrough": passthrough, "keyvalue": keyvalue, "scored": scored}
SPECS = {passthrough: FLOAT_RECORDS, keyvalue: BYTE_RECORDS, scored: FLOAT_RECORDS,
         bare_labels: IMAGE_RECORDS}


def run_stream(spark: SparkSession, job, *, source: str = "parquet", path: str | None = None,
               topic: str | None = None, bootstrap: str | None = None, outfile: str | None = None,
               outlog: str | None = None, timeout_ms: int | None = None, available_now: bool = False,
               checkpoint: str | None = None, model=None,
               starting_offsets=None, max_files_per_trigger: int | None = None,
               rejects_path: str | None = None, strict: bool = False, overwrite: bool = False,
               max_bytes_per_trigger: int | None = None, max_offsets_per_trigger: int | None = None,
               min_partitions: int | None = None, group: str | None = None, spec: RejectSpec | None = None,
               measures: dict | None = None, commits: str | None = None,
               job_name: str | None = None, wait: bool = True, wait_timeout_s: float | None = None):
    """U4 parameters -> a running query.  Results go to ``outfile`` when given, else to the record
    log ``outlog``, else to the ``<topic>-return`` topic.  A replayed log is read for ``topic``
    only, if one is given.  ``source="log"`` reads a committed record log by offsets: from
    ``starting_offsets``, or where ``group`` (default: the topic) left off; with ``available_now``
    up to the offsets that it has now, in micro-batches of ``max_offsets_per_trigger``.

    Malformed records (by the job's ``spec``) never reach the job and are never
    dropped: every micro-batch writes its result lines to ``outfile/batch_id=N``
    (or the return topic) and its rejects, whole records with their reason, to
    ``rejects_path/batch_id=N``, and then commits both with its counts in ``commits`` (see
    ``streaming.commits``).  Without ``rejects_path`` they go to
    ``<outfile>-rejects``, or to the progress folder if results go to a topic; without ``commits``
    the manifests go to ``<outfile>-commits`` in the same way.  ``strict``
    fails the query on the first malformed record instead.

    Progress is kept in ``checkpoint``; without one, in a folder named after job,
    topic, path and outfile below the shared folder, so a second run of the same job
    goes on where the first stopped.  ``overwrite=True`` starts over: earlier output,
    rejects, commits and progress of that name go."""
    name = job_name or (job if isinstance(job, str) else getattr(job, "__name__", "job"))
    fn = JOBS.get(job, job) if isinstance(job, str) else job
    progress = checkpoint or stable_path(spark, name, topic or "", path or bootstrap or "", outfile or outlog or "")
    beside = outfile.rstrip("/") if outfile else progress
    rejects_path, commits = rejects_path or beside + "-rejects", commits or beside + "-commits"
    planned = progress + "-source"
    if overwrite:
        for old in (outfile, rejects_path, commits, progress, planned):
            if old:
                delete_path(spark, old)
    elif outfile and path_exists(spark, outfile) and not path_exists(spark, progress):
        raise FileExistsError(f"{outfile} holds another run's output; pass overwrite=True or "
                              "that run's checkpoint")
    by_offsets = source == "log"
    replay = {"ending_offsets": latest_offsets(path) if available_now else None,
              "group": group or topic or DEFAULT_TOPIC, "progress": planned} if by_offsets else {}
    records = record_stream(spark, source, path=path,
                            topic=(topic or DEFAULT_TOPIC) if source == "kafka" else topic,
                            bootstrap=bootstrap, starting_offsets=starting_offsets,
                            max_files_per_trigger=max_files_per_trigger,
                            max_bytes_per_trigger=max_bytes_per_trigger,
                            max_offsets_per_trigger=max_offsets_per_trigger,
                            min_partitions=min_partitions, projection="all", **replay)
    spec = (spec or SPECS.get(fn, FLOAT_RECORDS)).for_model(model)
    tagged = tag_rejects(records, strict=strict, spec=spec)

    def apply(df):
        good = df.where(F.col(REASON).isNull()).drop(REASON)
        return fn(good, model) if model is not None else fn(good)

    target = ({"path": outfile} if outfile else {"log": outlog} if outlog else
              {"topic": return_topic_name(topic or DEFAULT_TOPIC), "bootstrap": bootstrap})
    bounded = by_offsets and available_now                  # the source itself ends the replay
    q = start_split(tagged, apply, REASON, progress, rejects_path, commits=commits, **target, timeout_ms=timeout_ms,
                    available_now=available_now and not bounded, measures=measures)
    if not wait:
        return q
    return drain(q) if bounded else run_to_end(q, wait_timeout_s)
