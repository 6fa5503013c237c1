"""Session construction and the shared scratch area.

Derived files (record logs, CSV renderings, IDX files, stream checkpoints) are
written below the folder the cluster names in ``spark.checkpoint.dir`` so that
every executor sees them and a lost executor never takes them along.  A folder
of our own is only chosen by a ``local`` session that names none; on a cluster that is an
error.  ``drop_derived`` removes what a session derived; the launcher and the bench call it.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Defaults that suit a local[N] run; on a cluster the submitter's settings win
# because ``getOrCreate`` keeps an existing session's configuration.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.python.worker.reuse": "true",
}


def get_session(master: str | None = None, app: str = "framescore",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               f"executors share; {sc.master} has no such folder by itself")
        configured = tempfile.mkdtemp(prefix="framescore-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    return f"{_derived_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _derived_root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/framescore"


def drop_derived(spark: SparkSession) -> None:
    """Remove every derived folder of this session (its results must have been read)."""
    delete_path(spark, _derived_root(spark))


def stable_path(spark: SparkSession, *parts: str) -> str:
    """A folder that later runs with the same parts find again (stream progress).

    Below the shared folder itself, not below this application's part of it."""
    sc = spark.sparkContext
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or sc.getConf().get("spark.checkpoint.dir", None))
    base = (configured or os.path.dirname(ensure_checkpoint_dir(spark))).rstrip("/")
    key = hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]
    return f"{base}/framescore-progress/{parts[0]}-{key}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers import it whatever
    their working folder and path (once per application)."""
    sc = spark.sparkContext
    if sc.__dict__.setdefault("_framescore_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="framescore-ship-")          # served until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "framescore-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("framescore", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc.__dict__["_framescore_shipped"] = True


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder and
    reading it back (columnar, so later readers load only the columns they use)."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _filesystem(path: str):
    """pyarrow filesystem + path for a local path or a URI (file, s3, gs, hdfs...)."""
    import pyarrow.fs as pafs
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        path = "file://" + os.path.abspath(path)
    for hadoop_scheme in ("s3a://", "s3n://"):      # Hadoop's names for the S3 scheme
        if path.startswith(hadoop_scheme):
            path = "s3://" + path[len(hadoop_scheme):]
    return pafs.FileSystem.from_uri(path)


def write_bytes(path: str, data: bytes) -> None:
    """Write a whole file atomically (temp name, then rename) on any filesystem
    pyarrow can reach, so a retried task replaces its own output."""
    fs, p = _filesystem(path)
    parent = p.rsplit("/", 1)[0]
    if parent:
        fs.create_dir(parent, recursive=True)
    tmp = f"{p}.tmp-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, p)


def read_bytes(path: str) -> bytes:
    fs, p = _filesystem(path)
    with fs.open_input_stream(p) as inp:
        return inp.read()


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hp = _hadoop_path(spark, path)
    return bool(fs.exists(hp))


def delete_path(spark: SparkSession, path: str) -> None:
    """Recursive delete through the Hadoop FileSystem of ``path`` (any scheme)."""
    fs, hp = _hadoop_path(spark, path)
    if fs.exists(hp):
        fs.delete(hp, True)
