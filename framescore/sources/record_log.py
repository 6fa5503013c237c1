"""S1/S5/S6 and K1/K3 without a broker: a committed record log as a Spark data source.

    spark.dataSource.register(RecordLog)                   # ``record_stream`` and ``write_log`` do it
    spark.readStream.format("record_log").option("path", log).option("startingOffsets", '{"0": 40}')

A log is a folder.  ``segments/`` holds parquet files, each the records that one task wrote to one
topic partition; ``commits/`` holds a manifest per committed write, which names its segments, gives
each its base offset, and states every partition's end.  Offsets are therefore dense, are assigned
when a write commits, and a record that no manifest names does not exist: a task that fails, or a
driver that dies before the manifest is there, leaves nothing that a reader sees.  A write that
names its ``writer`` and ``batch`` commits once, however often it is retried.  One writer appends
to a log at a time.

Reading (stream or batch) is by offsets.  ``startingOffsets``: ``earliest``, ``latest``, a JSON object
``{partition: offset}`` (partitions that it doesn't name start at 0), or ``group``, which goes on
where the consumer group's last committed batch ended (without one: at the latest).  ``group`` names
the consumer group; its progress lies in ``groups/<group>/`` of the log, outside any checkpoint.
``endingOffsets`` bounds a replay.  ``maxOffsetsPerTrigger`` bounds a micro-batch, dealt to the
partitions by what they have left; it needs ``progress``, a folder of the query's own (beside its
checkpoint), where the source notes what it planned, as Spark does not tell a source where it is.
``minPartitions`` cuts long ranges, so that one hot partition is read by many tasks.  Only manifests
reach the driver, never records.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

from framescore.session import _filesystem, read_bytes, write_bytes

FORMAT = "record_log"
DEFAULT_PARTITIONS = 4
READ_ROWS = 10_000

_STORED = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()),
                     ("timestamp", pa.timestamp("us", tz="UTC")), ("timestampType", pa.int32())])
_READ = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()),
                   ("offset", pa.int64()), ("timestamp", pa.timestamp("us", tz="UTC")), ("timestampType", pa.int32())])
SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("timestampType", T.IntegerType())])


# ------------------------------------------------------------------ manifests

class Manifests:
    """The committed state of a log; a manifest is read once."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self._seen: dict[str, dict] = {}

    def all(self) -> list[dict]:
        fs, folder = _filesystem(f"{self.path}/commits")
        listed = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        for name in sorted(f.base_name for f in listed if f.base_name.endswith(".json")):
            if name not in self._seen:
                self._seen[name] = json.loads(read_bytes(f"{self.path}/commits/{name}"))
        return [self._seen[name] for name in sorted(self._seen)]

    def ends(self) -> dict[int, int]:
        commits = self.all()
        return {int(p): o for p, o in commits[-1]["ends"].items()} if commits else {}

    def append(self, written: list[dict], writer: str | None, batch: int | None) -> bool:
        """Commit segments ``{partition, rows, file}`` in their order; False if that batch is in the log already."""
        commits = self.all()
        if writer is not None and any(c["writer"] == writer and c["batch"] == batch for c in commits):
            return False
        ends = dict(commits[-1]["ends"]) if commits else {}
        segments = []
        for s in written:
            base = ends.get(str(s["partition"]), 0)
            segments.append({**s, "base": base})
            ends[str(s["partition"])] = base + s["rows"]
        seq = commits[-1]["seq"] + 1 if commits else 0
        write_bytes(f"{self.path}/commits/{seq:020d}.json", json.dumps(
            {"seq": seq, "writer": writer, "batch": batch, "segments": segments, "ends": ends}).encode())
        return True

    def segments(self, start: dict[int, int], end: dict[int, int]) -> dict[int, list[tuple[str, int, int, int]]]:
        """Per partition the (file, first row, rows, offset of the first) that hold the range, in order."""
        out: dict[int, list] = {}
        for commit in self.all():
            for s in commit["segments"]:
                p = s["partition"]
                lo, hi = max(s["base"], start.get(p, 0)), min(s["base"] + s["rows"], end.get(p, 0))
                if lo < hi:
                    out.setdefault(p, []).append((s["file"], lo - s["base"], hi - lo, lo))
        return out


def _offsets(named: dict) -> dict[int, int]:
    return {int(p): int(o) for p, o in named.items()}


def _json(offsets: dict[int, int]) -> dict:
    return {str(p): offsets[p] for p in sorted(offsets)}


def deal(start: dict[int, int], end: dict[int, int], most: int) -> dict[int, int]:
    """At most ``most`` records from ``start`` towards ``end``, by what each partition has left."""
    left = {p: max(0, e - start.get(p, 0)) for p, e in end.items()}
    total = sum(left.values())
    if total <= most:
        return {p: max(e, start.get(p, 0)) for p, e in end.items()}
    share = {p: n * most // total for p, n in left.items()}
    spare = most - sum(share.values())                       # what rounding left, to the longest
    for p in sorted(left, key=lambda p: (-left[p], p)):
        more = min(spare, left[p] - share[p], 1)
        share[p], spare = share[p] + more, spare - more
    return {p: start.get(p, 0) + share[p] for p in end}


# ------------------------------------------------------------------ reading

@dataclass
class Slice(InputPartition):
    """Rows of segments of one topic partition."""

    path: str
    partition: int
    pieces: list[tuple[str, int, int, int]]


def slices(path: str, segments: dict[int, list[tuple[str, int, int, int]]], at_least: int | None) -> list[Slice]:
    """One slice per topic partition, or ranges of about a ``at_least``-th of all records."""
    total = sum(n for pieces in segments.values() for _, _, n, _ in pieces)
    most = total if not at_least else max(1, -(-total // at_least))
    out = []
    for p, pieces in sorted(segments.items()):
        held, room = [], most
        for file, row, n, offset in pieces:
            while n:
                take = min(n, room)
                held.append((file, row, take, offset))
                row, offset, n, room = row + take, offset + take, n - take, room - take
                if not room:
                    out.append(Slice(path, p, held))
                    held, room = [], most
        if held:
            out.append(Slice(path, p, held))
    return out


def read_slice(s: Slice) -> Iterator[pa.RecordBatch]:
    """The records in offset order, a bounded batch at a time; row groups outside the range are not read."""
    for file, row, n, offset in s.pieces:
        fs, name = _filesystem(f"{s.path}/segments/{file}")
        with fs.open_input_file(name) as source:
            stored = pq.ParquetFile(source)
            groups, first = [], 0
            skipped = None
            for g in range(stored.num_row_groups):
                size = stored.metadata.row_group(g).num_rows
                if first < row + n and first + size > row:
                    skipped = first if skipped is None else skipped
                    groups.append(g)
                first += size
            at = skipped or 0
            for batch in stored.iter_batches(READ_ROWS, row_groups=groups):
                lo, hi = max(0, row - at), min(batch.num_rows, row + n - at)
                at += batch.num_rows
                if lo < hi:
                    part = batch.slice(lo, hi - lo)
                    place = {"partition": pa.array(np.full(hi - lo, s.partition, np.int32)),
                             "offset": pa.array(np.arange(offset, offset + hi - lo, dtype=np.int64))}
                    offset += hi - lo
                    yield pa.RecordBatch.from_arrays(
                        [place[f.name] if f.name in place else part.column(f.name) for f in _READ], schema=_READ)


class _Reading:
    """Options that stream and batch reading share."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.starting = options.get("startingOffsets")
        self.ending = options.get("endingOffsets")
        self.group = options.get("group")
        self.most = int(options["maxOffsetsPerTrigger"]) if options.get("maxOffsetsPerTrigger") else None
        self.at_least = int(options["minPartitions"]) if options.get("minPartitions") else None
        self.log = Manifests(self.path)
        self.progress = options.get("progress")
        if self.most and not self.progress:
            raise ValueError("maxOffsetsPerTrigger needs progress, a folder of the query's own")

    def _load(self, folder: str, name: str) -> dict[int, int] | None:
        fs, file = _filesystem(f"{folder}/{name}.json")
        if fs.get_file_info(file).type == pafs.FileType.NotFound:
            return None
        return _offsets(json.loads(read_bytes(f"{folder}/{name}.json")))

    def _save(self, folder: str, name: str, offsets: dict[int, int]) -> None:
        write_bytes(f"{folder}/{name}.json", json.dumps(_json(offsets)).encode())

    def committed(self) -> dict[int, int] | None:
        return self._load(f"{self.path}/groups/{self.group}", "committed") if self.group else None

    def start(self, default: str) -> dict[int, int]:
        named, ends = self.starting or default, self.log.ends()
        if named == "group":
            committed = self.committed()
            named = "latest" if committed is None else json.dumps(_json(committed))
        if named == "earliest":
            return dict.fromkeys(ends, 0)
        if named == "latest":
            return ends
        given = _offsets(json.loads(named))
        return {p: given.get(p, 0) for p in {*ends, *given}}

    def end(self) -> dict[int, int]:
        ends = self.log.ends()
        if not self.ending or self.ending == "latest":
            return ends
        given = _offsets(json.loads(self.ending))
        return {p: min(e, given.get(p, e)) for p, e in ends.items()}

    def plan(self, start: dict[int, int], end: dict[int, int]) -> list[Slice]:
        return slices(self.path, self.log.segments(start, end), self.at_least)


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return self.plan(self.start("earliest"), self.end())

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(partition)


class LogStreamReader(_Reading, DataSourceStreamReader):
    """Progress is ``{partition: offset}``.  Spark asks for the latest offset before the initial one, and
    after a restart for neither start; so both that and the last planned end are noted in ``progress``."""

    initial: dict[int, int] | None = None
    at: dict[int, int] | None = None

    def _begin(self) -> dict[int, int]:
        if self.initial is None:
            noted = self._load(self.progress, "initial") if self.progress else None
            self.initial = self.start("group") if noted is None else noted
            if self.progress and noted is None:
                self._save(self.progress, "initial", self.initial)
        return self.initial

    def initialOffset(self) -> dict:
        return _json(self._begin())

    def latestOffset(self) -> dict:
        if self.at is None:
            planned = self._load(self.progress, "planned") if self.progress else None
            self.at = self._begin() if planned is None else planned
        end = self.end()
        end = {p: max(end.get(p, 0), self.at.get(p, 0)) for p in {*end, *self.at}}
        if self.most:
            end = deal(self.at, end, self.most)
        if self.progress and end != self.at:
            self._save(self.progress, "planned", end)
        self.at = end
        return _json(end)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.plan(_offsets(start), _offsets(end))

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(partition)

    def commit(self, end: dict) -> None:
        if self.group:
            self._save(f"{self.path}/groups/{self.group}", "committed", _offsets(end))


# ------------------------------------------------------------------ writing

@dataclass
class Written(WriterCommitMessage):
    segments: list[dict]


def topic_partition(keys: pa.Array, given: pa.Array | None, n: int, turn: int) -> np.ndarray:
    """The partition given, else one by the key's checksum; records without a key are dealt in turn."""
    own = np.array([zlib.crc32(k) % n if k is not None else (turn + i) % n for i, k in enumerate(keys.to_pylist())], np.int64)
    if given is None:
        return own
    known = given.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, given.fill_null(0).to_numpy(zero_copy_only=False), own)


class _Writing:
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.n = int(options.get("partitions", DEFAULT_PARTITIONS))
        self.topic = options.get("topic")
        self.writer = options.get("writer")
        self.batch = int(options["batch"]) if options.get("batch") is not None else None

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        turn, open_files = TaskContext.get().partitionId(), {}
        fs, folder = _filesystem(f"{self.path}/segments")
        fs.create_dir(folder, recursive=True)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = set(batch.schema.names)
                table = pa.table({f.name: (batch.column(f.name).cast(f.type) if f.name in names
                                           else pa.nulls(batch.num_rows, f.type)) for f in _STORED})
                if self.topic is not None:
                    table = table.set_column(2, _STORED.field(2), pa.array([self.topic] * len(table), pa.string()))
                where = topic_partition(table.column("key").combine_chunks(),
                                        batch.column("partition") if "partition" in names else None, self.n, turn)
                turn += len(where)
                for p in np.unique(where).tolist():
                    if p not in open_files:
                        name = f"{p}-{uuid.uuid4().hex}.parquet"
                        sink = fs.open_output_stream(f"{folder}/{name}")
                        open_files[p] = [name, sink, pq.ParquetWriter(sink, _STORED), 0]
                    rows = table.take(np.flatnonzero(where == p))      # in the order in which they came
                    open_files[p][2].write_table(rows)
                    open_files[p][3] += len(rows)
            for _, sink, out, _ in open_files.values():
                out.close()
                sink.close()
        except BaseException:
            self._drop([f[0] for f in open_files.values()])
            raise
        return Written([{"partition": p, "rows": rows, "file": name} for p, (name, _, _, rows) in sorted(open_files.items())])

    def _drop(self, names: list[str]) -> None:
        fs, folder = _filesystem(f"{self.path}/segments")
        for name in names:
            if fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.File:
                fs.delete_file(f"{folder}/{name}")

    def _commit(self, messages: list[Written | None], batch: int | None) -> None:
        segments = [s for m in messages if m is not None for s in m.segments]
        if not Manifests(self.path).append(segments, self.writer, batch):
            self._drop([s["file"] for s in segments])

    def _abort(self, messages: list[Written | None]) -> None:
        self._drop([s["file"] for m in messages if m is not None for s in m.segments])


class LogWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class LogStreamWriter(_Writing, DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        if not self.writer:
            raise ValueError("a stream into a record log needs a writer name, which its batches are committed under")

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema: T.StructType) -> LogStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a record log is only appended to")
        return LogWriter(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options)


# ------------------------------------------------------------------ DataFrames

def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLog)


def _records(df: DataFrame) -> DataFrame:
    """The columns that a log takes, in its types; missing ones are null."""
    kept = [f for f in SCHEMA.fields if f.name != "offset"]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kept])


def write_log(df: DataFrame, path: str, *, topic: str | None = None, partitions: int = DEFAULT_PARTITIONS,
              writer: str | None = None, batch: int | None = None) -> None:
    """K3: append records (key, value and, where known, partition, topic, timestamp) in one commit.  Offsets
    follow the order of tasks and rows.  ``writer`` and ``batch`` make a retried write commit once."""
    register(df.sparkSession)
    w = _records(df).write.format(FORMAT).mode("append").option("path", path).option("partitions", partitions)
    for name, value in (("topic", topic), ("writer", writer), ("batch", batch)):
        w = w if value is None else w.option(name, value)
    w.save()


def log_options(path: str, starting_offsets=None, ending_offsets=None, group: str | None = None,
                max_offsets_per_trigger: int | None = None, min_partitions: int | None = None,
                progress: str | None = None) -> dict:
    """Reader options; offsets may be given as a mapping."""
    named = {"startingOffsets": starting_offsets, "endingOffsets": ending_offsets}
    opts = {k: json.dumps({str(p): int(o) for p, o in v.items()}) if isinstance(v, dict) else v for k, v in named.items()}
    opts |= {"path": path, "group": group, "maxOffsetsPerTrigger": max_offsets_per_trigger, "minPartitions": min_partitions,
             "progress": progress}
    return {k: str(v) for k, v in opts.items() if v is not None}


def read_log(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """The log's records with partition and offset; options as of ``log_options``."""
    register(spark)
    reader = spark.readStream if streaming else spark.read
    return reader.format(FORMAT).options(**log_options(path, **options)).load()


def latest_offsets(path: str) -> dict[int, int]:
    return Manifests(path).ends()


def group_offsets(path: str, group: str) -> dict[int, int] | None:
    """Where the consumer group's last committed batch ended."""
    return _Reading({"path": path, "group": group}).committed()
