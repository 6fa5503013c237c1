"""Running a stateless record pipeline as a streaming query.

* T1 progress: offset and commit logs in ``checkpointLocation`` (one entry
  per micro-batch) under the shared checkpoint folder.
* T2 latency knob: ``trigger(processingTime=<n> milliseconds)``.
* T3 unbounded input; bounded replay of a record log is ``availableNow``.
* T4 source -> map -> sink with no exchange, append mode.
* T5 ``start()`` + ``awaitTermination``.

Sinks: ``kafka`` (K1), ``parquet``/``text`` file sinks (append, exactly-once
through the sink's own log), ``memory`` for tests, ``overwrite-text`` (K2 under
streaming) via ``foreachBatch``, and ``start_split``, which keeps rejects as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescore.operators.rejects import REASONS
from framescore.sinks.results import kafka_sink_options
from framescore.sources.record_log import write_log
from framescore.sources.records import KAFKA_HINT
from framescore.streaming.commits import REJECT_SCHEMA, commit, is_committed


def trigger_args(timeout_ms: int | None = None, available_now: bool = False,
                 once: bool = False) -> dict:
    if available_now:
        return {"availableNow": True}
    if once:
        return {"once": True}
    if timeout_ms is not None:
        return {"processingTime": f"{int(timeout_ms)} milliseconds"}
    return {}


def start_stream(df: DataFrame, sink: str, checkpoint: str, *, path: str | None = None,
                 topic: str | None = None, bootstrap: str | None = None,
                 query_name: str | None = None, timeout_ms: int | None = None,
                 available_now: bool = False, output_col: str = "value") -> StreamingQuery:
    w = df.writeStream.option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    trig = trigger_args(timeout_ms, available_now)
    if trig:
        w = w.trigger(**trig)
    if sink == "kafka":
        try:
            return (df.select(output_col).writeStream.format("kafka")
                    .options(**kafka_sink_options(topic, bootstrap, checkpoint=checkpoint))
                    .trigger(**(trig or {"processingTime": "0 seconds"})).start())
        except Exception as e:  # noqa: BLE001 - re-raised with the fix
            if "Failed to find data source" in str(e):
                raise RuntimeError(KAFKA_HINT.format(version=df.sparkSession.version)) from e
            raise
    if sink == "overwrite-text":
        def per_batch(batch: DataFrame, batch_id: int):
            (batch.select(output_col).write.mode("overwrite")
                  .text(f"{path.rstrip('/')}/batch_id={batch_id}"))
        return w.foreachBatch(per_batch).start()
    if sink == "memory":
        return w.format("memory").outputMode("append").start()
    return w.format(sink).outputMode("append").option("path", path).start()


def start_split(tagged: DataFrame, apply, reason: str, checkpoint: str, rejects_path: str, *,
                commits: str, path: str | None = None, topic: str | None = None, bootstrap: str | None = None,
                log: str | None = None, timeout_ms: int | None = None, available_now: bool = False,
                measures: dict | None = None) -> StreamingQuery:
    """Result lines and rejects of every micro-batch to their own places, under one commit.

    ``tagged`` holds the records with their reject reason.  Lines go below ``path``, to the record
    log ``log``, or to the broker.  Records, reasons and ``measures`` (aggregates of the job's output,
    by name) are observed while the lines are written; only a batch that has rejects is read again
    for them.  The manifest in ``commits`` comes last (see ``commits``)."""
    if topic is not None:
        _broker_or_hint(tagged, topic, bootstrap, checkpoint)

    def per_batch(batch: DataFrame, batch_id: int):
        if is_committed(commits, batch_id):               # it ended after its commit: nothing to write
            return
        seen, told = Observation(), Observation()
        counts = [F.count(F.when(F.col(reason) == r, 1)).alias(r) for r in REASONS]
        out = apply(batch.observe(seen, F.count(F.lit(1)).alias("records"), *counts))
        exprs = [m.cast("double").alias(f"m_{name}") for name, m in (measures or {}).items()]
        lines = out.observe(told, F.count(F.lit(1)).alias("lines"), *exprs).select("value")
        place = f"batch_id={batch_id}"
        if path is not None:
            lines.write.mode("overwrite").text(f"{path.rstrip('/')}/{place}")
        elif log is not None:
            write_log(lines.select(F.encode("value", "UTF-8").alias("value")), log, writer=checkpoint, batch=batch_id)
        else:
            lines.write.format("kafka").options(**kafka_sink_options(topic, bootstrap)).save()
        rejects = {r: n for r, n in seen.get.items() if r != "records" and n}
        if rejects or batch_id == 0:                      # the first writes them anyway, so that they can be read
            (batch.where(F.col(reason).isNotNull()).select(*[F.col(f.name).cast(f.dataType) for f in REJECT_SCHEMA.fields])
                  .write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/{place}"))
        commit(commits, batch_id, records=seen.get["records"], lines=told.get["lines"], rejects=rejects,
               measures={name: told.get[f"m_{name}"] for name in measures or {}},
               lines_path=path and f"{path.rstrip('/')}/{place}",
               rejects_path=f"{rejects_path.rstrip('/')}/{place}" if rejects else None)

    w = tagged.writeStream.option("checkpointLocation", checkpoint)
    trig = trigger_args(timeout_ms, available_now)
    return (w.trigger(**trig) if trig else w).foreachBatch(per_batch).start()


def _broker_or_hint(df: DataFrame, topic: str, bootstrap: str, checkpoint: str) -> None:
    """Fail before the stream starts if there is no connector for its sink."""
    try:
        df.sparkSession._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.kafka010.KafkaSourceProvider", False,
            df.sparkSession._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception as e:  # noqa: BLE001 - re-raised with the fix
        raise RuntimeError(KAFKA_HINT.format(version=df.sparkSession.version)) from e


def drain(q: StreamingQuery) -> StreamingQuery:
    """T5 for a replay that its source bounds: every micro-batch up to the source's end, then stop."""
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def run_to_end(q: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """T5 for bounded replay: wait until the query stops (availableNow)."""
    if timeout_s is None:
        q.awaitTermination()
    else:
        done = q.awaitTermination(timeout_s)
        if not done:
            q.stop()
            raise TimeoutError(f"streaming query did not finish within {timeout_s} s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q
