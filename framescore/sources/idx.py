"""Gzip IDX image and label files as tables.

IDX layout (big-endian int32 header, magic not checked):
  images: magic, count, rows, cols, then count*rows*cols unsigned bytes
  labels: magic, count, then count unsigned bytes

Files are listed by ``binaryFile`` (path only, contents not loaded) and each
one is opened through pyarrow's filesystem layer and decompressed as a stream
inside ``mapInArrow``, ``chunk`` records at a time; many files scan in parallel.  Rows come
out in Arrow batches of ``chunk`` records; ``repartition`` after the scan spreads a few big
files over all cores.

With ``split_bytes`` one large file is read by many tasks: a first pass streams each file once
and writes an index of restart points (``sources.gzip_ranges``, 32 KB for each ``split_bytes`` of
output), and the read deals its ranges out.  A record belongs to the range in which it starts, so
each is read once; a range's task reads on past its end for the last record's rest.

``write_idx_pair`` is the writer side used to derive IDX files from a table:
each task writes its own rows as image/label file pairs of bounded size
through pyarrow's filesystem layer into the shared folder, under names fixed
by (partition, chunk), so a retried task rewrites the same files atomically.
"""

from __future__ import annotations

import gzip
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescore.functions.codec import _binary_parts, _gather
from framescore.session import materialize, write_bytes
from framescore.sources.gzip_ranges import Range, ranges, read_range

IMAGE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("rows", T.IntegerType()),
    T.StructField("cols", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()),
])
LABEL_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("label", T.IntegerType()),
])

# IDX magic numbers and file name suffixes.
IMAGE_MAGIC = 2051
LABEL_MAGIC = 2049
IMAGE_SUFFIX = "-images-idx3-ubyte.gz"
LABEL_SUFFIX = "-labels-idx1-ubyte.gz"
_SUFFIX_RE = re.compile(r"[-.](images|labels)-idx\d-ubyte(\.gz)?$")

CHUNK = 4096
#: ranges of a file that one task reads on average, where there are more than shuffle partitions
RANGES_PER_TASK = 16


def source_key(path: str) -> str:
    """Pairing key of an IDX file: its name without the images/labels suffix."""
    name = os.path.basename(path)
    return _SUFFIX_RE.sub("", name)


def _read_exact(stream, n: int) -> bytes:
    buf = stream.read(n)
    if len(buf) != n:
        raise ValueError(f"truncated IDX file: wanted {n} bytes, got {len(buf)}")
    return buf


def _open_gzip(path: str):
    """Decompressing input stream for a local path or URI (pyarrow.fs, C++ gzip)."""
    from framescore.session import _filesystem
    fs, p = _filesystem(path)
    return fs.open_input_stream(p, compression="gzip")


def _header(kind: str, head: bytes) -> tuple[int, int, int, int]:
    """(bytes of the header, count, rows, cols) of an IDX file's first bytes."""
    size = 16 if kind == "images" else 8
    if len(head) < size:
        raise ValueError(f"truncated IDX file: wanted {size} bytes, got {len(head)}")
    if kind == "images":
        return (size, *struct.unpack(">iii", head[4:16]))
    return size, struct.unpack(">i", head[4:8])[0], 1, 1


def _record_batch(kind: str, src: str, s: int, e: int, h: int, w: int, body: bytes) -> pa.RecordBatch:
    """Records ``s`` to ``e`` of a file, whose bytes are ``body``."""
    pos = pa.array(np.arange(s, e, dtype=np.int64))
    srcs = pa.array([src] * (e - s), type=pa.string())
    if kind == "labels":
        lab = pa.array(np.frombuffer(body, dtype=np.uint8).astype(np.int32))
        return pa.RecordBatch.from_arrays([srcs, pos, lab], schema=_arrow_schema(LABEL_SCHEMA))
    offs = np.arange(e - s + 1, dtype=np.int32) * np.int32(h * w)
    pixels = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(body)])
    hs = pa.array(np.full(e - s, h, dtype=np.int32))
    ws = pa.array(np.full(e - s, w, dtype=np.int32))
    return pa.RecordBatch.from_arrays([srcs, pos, hs, ws, pixels], schema=_arrow_schema(IMAGE_SCHEMA))


def _scan(kind: str, chunk: int):
    def run(batches):
        for rb in batches:
            for p in rb.column("path").to_pylist():
                with _open_gzip(p) as stream:
                    _, count, h, w = _header(kind, _read_exact(stream, 16 if kind == "images" else 8))
                    for s in range(0, count, chunk):
                        e = min(count, s + chunk)
                        yield _record_batch(kind, source_key(p), s, e, h, w, _read_exact(stream, (e - s) * h * w))
    return run


INDEX_SCHEMA = ("path string, count int, rows int, cols int, byte bigint, bit int, window binary, "
                "start bigint, end bigint, crc bigint")


def _index(kind: str, split_bytes: int):
    """Paths -> a row for each range of the file, with the header's values."""
    from framescore.session import _filesystem

    def run(batches):
        for rb in batches:
            for p in rb.column("path").to_pylist():
                fs, name = _filesystem(p)
                head = bytearray()

                def note(data, head=head):
                    if len(head) < 16:
                        head.extend(data[:16])

                end = 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in ranges(stream, split_bytes, note):
                        size, count, h, w = _header(kind, bytes(head))
                        end = r.end
                        yield pa.RecordBatch.from_pylist([{
                            "path": p, "count": count, "rows": h, "cols": w, **r._asdict()}],
                            schema=_INDEX_ARROW)
                if end < size + count * h * w:
                    raise ValueError(f"truncated IDX file: wanted {size + count * h * w} bytes, got {end}")
    return run


_INDEX_ARROW = pa.schema([("path", pa.string()), ("count", pa.int32()), ("rows", pa.int32()), ("cols", pa.int32()),
                          ("byte", pa.int64()), ("bit", pa.int32()), ("window", pa.binary()),
                          ("start", pa.int64()), ("end", pa.int64()), ("crc", pa.int64())])


def _scan_ranges(kind: str, chunk: int):
    """Rows of the index -> the records that start in their ranges."""
    from framescore.session import _filesystem

    def records(row):
        size = 16 if kind == "images" else 8
        h, w = row["rows"], row["cols"]
        d, r = h * w, Range(*[row[f] for f in Range._fields])
        if d == 0:                              # empty images lie nowhere: the first range gives them
            for s in range(0, row["count"] if r.start == 0 else 0, chunk):
                e = min(row["count"], s + chunk)
                yield _record_batch(kind, source_key(row["path"]), s, e, h, w, b"")
            return
        first = max(0, -(-(r.start - size) // d))
        last = min(row["count"], max(0, -(-(r.end - size) // d)))
        if first >= last:
            return
        skip, held = size + first * d - r.start, bytearray()
        fs, name = _filesystem(row["path"])
        with fs.open_input_file(name) as stream:
            stream.seek(r.byte)
            for part in read_range(stream, r):
                held += part
                if skip:
                    gone = min(skip, len(held))
                    del held[:gone]
                    skip -= gone
                while first < last and len(held) >= min(chunk, last - first) * d:
                    e = min(last, first + chunk)
                    body = bytes(held[:(e - first) * d])
                    del held[:len(body)]
                    yield _record_batch(kind, source_key(row["path"]), first, e, h, w, body)
                    first = e
                if first == last and not skip:
                    break
        if first < last:
            raise ValueError("truncated IDX file: it ends inside a record that its index counts")

    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                yield from records(row)
    return run


def idx_index(spark: SparkSession, path: str, kind: str, glob: str, split_bytes: int) -> DataFrame:
    """The ranges of every gzip IDX file below ``path``, written once: file, header values, place of the
    restart point, its window, output bytes ``[start, end)`` and their CRC."""
    if split_bytes < 1 << 10:
        raise ValueError("split_bytes: a range of an IDX file has 1,024 bytes at least")
    return materialize(_files(spark, path, glob).mapInArrow(_index(kind, split_bytes), INDEX_SCHEMA), "idx-index")


def _read(spark: SparkSession, path: str, kind: str, glob: str, repartition: int | None, chunk: int,
          split_bytes: int | None, schema: T.StructType) -> DataFrame:
    if split_bytes:
        index = idx_index(spark, path, kind, glob, split_bytes)
        n = index.count()
        tasks = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGES_PER_TASK))
        df = index.repartition(max(1, tasks)).mapInArrow(_scan_ranges(kind, chunk), schema)
    else:
        df = _files(spark, path, glob).mapInArrow(_scan(kind, chunk), schema)
    return df.repartition(repartition) if repartition else df


def _arrow_schema(st: T.StructType) -> pa.Schema:
    m = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
         T.BinaryType: pa.binary()}
    return pa.schema([pa.field(f.name, m[type(f.dataType)]) for f in st.fields])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """File listing only: ``content`` is never selected, so Spark does not read
    the files (and the 2 GB per-file row limit does not apply); the listing is
    still split across tasks by file size."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path).select("path"))


def idx_images(spark: SparkSession, path: str, glob: str = "*images-idx3-ubyte.gz",
               repartition: int | None = None, chunk: int = CHUNK,
               split_bytes: int | None = None) -> DataFrame:
    """``(source, pos, rows, cols, pixels BINARY)``, one row per image.  ``split_bytes``: files are
    indexed first and read in ranges of about that many bytes of output."""
    return _read(spark, path, "images", glob, repartition, chunk, split_bytes, IMAGE_SCHEMA)


def idx_labels(spark: SparkSession, path: str, glob: str = "*labels-idx1-ubyte.gz",
               repartition: int | None = None, chunk: int = CHUNK,
               split_bytes: int | None = None) -> DataFrame:
    """``(source, pos, label INT)``, one row per label (``split_bytes`` as for images)."""
    return _read(spark, path, "labels", glob, repartition, chunk, split_bytes, LABEL_SCHEMA)


def encode_idx(pixels: bytes, labels: bytes | None, count: int, h: int, w: int):
    """Bytes of an IDX image file and (optionally) a label file, gzip-compressed."""
    if len(pixels) != count * h * w:
        raise ValueError(f"{count} images of {len(pixels)} bytes, expected {h * w} bytes each")
    img = gzip.compress(struct.pack(">iiii", IMAGE_MAGIC, count, h, w) + pixels)
    if labels is None:
        return img, None
    return img, gzip.compress(struct.pack(">ii", LABEL_MAGIC, count) + labels)


def write_idx_pair(df: DataFrame, path: str, pixels: str, label: str, h: int, w: int,
                   order_by: str | None = None, rows_per_file: int = 100_000) -> DataFrame:
    """Write ``df`` as paired gzip IDX files without a shuffle.

    Every task writes its own input partition, ``rows_per_file`` rows per file
    pair (``part-<partition>-<chunk>``), so memory per task is bounded and a
    huge or skewed input never meets in one task.  ``order_by`` sorts rows
    within each task first (no shuffle), making the positions deterministic.
    Returns the manifest ``(source, n)`` after writing it next to the files,
    so nothing passes through the driver.
    """
    from pyspark import TaskContext

    base = path.rstrip("/")
    whole = F.col(pixels).isNotNull() & F.col(label).between(0, 255)
    bad = df.where(~F.coalesce(whole, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("an IDX file holds images with labels 0-255; drop or map the other rows first")
    staged = df.select(F.col(pixels).alias("pixels"), F.col(label).cast("int").alias("label"),
                       *([F.col(order_by).alias("_fs_order")] if order_by else []))
    if order_by:
        staged = staged.sortWithinPartitions("_fs_order")

    def write(batches):
        pid, chunk = TaskContext.get().partitionId(), 0
        pix, lab, held = [], [], 0

        def flush():
            src = f"part-{pid:05d}-{chunk:05d}"
            img, labs = encode_idx(b"".join(pix), b"".join(lab), held, h, w)
            write_bytes(f"{base}/{src}{IMAGE_SUFFIX}", img)
            write_bytes(f"{base}/{src}{LABEL_SUFFIX}", labs)
            return pa.RecordBatch.from_arrays([pa.array([src]), pa.array([held], pa.int64())],
                                              names=["source", "n"])

        for rb in batches:
            j = 0
            while j < rb.num_rows:
                part = rb.slice(j, min(rows_per_file - held, rb.num_rows - j))
                starts, lengths, data, _ = _binary_parts(part.column("pixels"))
                if (lengths != h * w).any():
                    raise ValueError(f"an image is not {h * w} bytes long")
                pix.append(_gather(starts, lengths, data).tobytes())
                lab.append(part.column("label").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                held, j = held + part.num_rows, j + part.num_rows
                if held == rows_per_file:
                    yield flush()
                    chunk += 1
                    pix, lab, held = [], [], 0
        if held:
            yield flush()

    manifest = staged.mapInArrow(write, "source string, n bigint")
    manifest.write.mode("overwrite").parquet(base + "/_manifest")
    return df.sparkSession.read.parquet(base + "/_manifest")


def quantize_pixels(features, offset: float = 1.0, scale: float = 128.0) -> "F.Column":
    """Floats -> unsigned-byte image: ``clamp(floor((x + offset) * scale), 0, 255)``."""
    f = F.col(features) if isinstance(features, str) else features
    byte = lambda x: F.least(F.greatest(F.floor((x.cast("double") + offset) * scale),
                                        F.lit(0)), F.lit(255))
    return F.unhex(F.array_join(F.transform(f, lambda x: F.lpad(F.hex(byte(x)), 2, "0")), ""))
