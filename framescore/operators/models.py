"""Scorers: ``predict(float32[n, d]) -> softmax scores [n, k]``.

Models are picklable objects shipped once to the executors as a file, whatever
their size (``ship_model``), and evaluated on whole Arrow batches.  Arithmetic is float64 inside; the
scorer emits float32 score vectors like the original graph outputs.

* ``DenseSoftmax``  - one dense layer + softmax (keypoint NN, image NN).
* ``LstmSoftmax``   - one LSTM layer over ``steps x features`` + dense softmax.
* ``OnnxModel``     - any ONNX file via onnxruntime, session built once per
  Python worker.

``fit_centroids`` builds the dense stand-in model (per-class mean vectors) in one
Arrow pass; the driver receives the k x d numbers of the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z)
    if z.dtype not in (np.float32, np.float64):
        z = z.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        m = np.max(z, axis=1, keepdims=True) if z.shape[1] else z
        e = np.exp(z - m)
        return e / np.sum(e, axis=1, keepdims=True)


class DenseSoftmax:
    """``softmax(x @ W.T + b)`` with W of shape [k, d].

    ``dtype`` is the arithmetic precision: float64 (default, reproducible
    probabilities) or float32 (the original graphs' precision, about twice the
    matmul throughput)."""

    def __init__(self, weights, bias=None, name: str = "dense", dtype=np.float64, labels=None):
        self.dtype = np.dtype(dtype)
        self.weights = np.asarray(weights, dtype=self.dtype)
        self.classes, self.width = self.weights.shape
        self.bias = (np.zeros(self.classes, dtype=self.dtype) if bias is None
                     else np.asarray(bias, dtype=self.dtype))
        self.name = name
        #: the label of each weight row, where that is not its number
        self.labels = None if labels is None else np.asarray(labels, dtype=np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, dtype=self.dtype) @ self.weights.T + self.bias

    def predict(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x))


class LstmSoftmax:
    """One LSTM layer (gate order i, f, g, o) over ``steps`` time steps of
    ``features`` values each, last hidden state -> dense -> softmax."""

    def __init__(self, steps: int, features: int, hidden: int, classes: int,
                 w_in, w_rec, b, w_out, b_out, name: str = "lstm"):
        self.steps, self.features, self.hidden, self.classes = steps, features, hidden, classes
        self.width = steps * features
        self.w_in = np.asarray(w_in, dtype=np.float64)      # [4h, f]
        self.w_rec = np.asarray(w_rec, dtype=np.float64)    # [4h, h]
        self.b = np.asarray(b, dtype=np.float64)            # [4h]
        self.w_out = np.asarray(w_out, dtype=np.float64)    # [k, h]
        self.b_out = np.asarray(b_out, dtype=np.float64)    # [k]
        self.name = name

    @classmethod
    def seeded(cls, steps: int = 8, features: int = 8, hidden: int = 16,
               classes: int = 10, seed: int = 7, scale: float = 0.5) -> "LstmSoftmax":
        rng = np.random.default_rng(seed)
        h4 = 4 * hidden
        return cls(steps, features, hidden, classes,
                   rng.normal(0, scale, (h4, features)), rng.normal(0, scale, (h4, hidden)),
                   rng.normal(0, scale, h4), rng.normal(0, scale, (classes, hidden)),
                   rng.normal(0, scale, classes))

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64).reshape(-1, self.steps, self.features)
        n, hd = x.shape[0], self.hidden
        # gate blocks reordered to (i, f, o | g) so the three sigmoids are one call
        order = np.r_[0:2 * hd, 3 * hd:4 * hd, 2 * hd:3 * hd]
        w_in, w_rec, b = self.w_in[order], self.w_rec[order], self.b[order]
        h = np.zeros((n, hd))
        c = np.zeros((n, hd))
        for t in range(self.steps):
            z = x[:, t, :] @ w_in.T
            z += h @ w_rec.T
            z += b
            sig = _sigmoid(z[:, :3 * hd])
            g = np.tanh(z[:, 3 * hd:])
            c = sig[:, hd:2 * hd] * c + sig[:, :hd] * g
            h = sig[:, 2 * hd:] * np.tanh(c)
        return h @ self.w_out.T + self.b_out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-z))


def _onnx_session(source):
    import onnxruntime as ort
    opts = ort.SessionOptions()
    opts.intra_op_num_threads = 1
    return ort.InferenceSession(source, opts, providers=["CPUExecutionProvider"])


def _onnx_dims(sess, width, classes):
    """Width/classes from the graph's static shapes when not given."""
    ishape = sess.get_inputs()[0].shape
    oshape = sess.get_outputs()[0].shape
    if width is None and len(ishape) == 2 and isinstance(ishape[1], int):
        width = ishape[1]
    if classes is None and len(oshape) == 2 and isinstance(oshape[1], int):
        classes = oshape[1]
    if width is None or classes is None:
        raise ValueError("model width/classes not given and not fixed in the graph")
    return int(width), int(classes)


class OnnxModel:
    """An ONNX graph (bytes) evaluated with onnxruntime.  The graph is loaded
    once on the driver to fail fast on a bad model; on the executors the
    inference session is created lazily once per Python worker and is never
    pickled."""

    def __init__(self, model_bytes: bytes, width: int | None = None,
                 classes: int | None = None, input_name: str | None = None,
                 output_name: str | None = None, name: str = "onnx", _validate: bool = True):
        self.model_bytes = model_bytes
        self.input_name, self.output_name = input_name, output_name
        self.name = name
        self._session = None
        if _validate:
            self.width, self.classes = _onnx_dims(_onnx_session(model_bytes), width, classes)
        else:
            self.width, self.classes = width, classes

    def __getstate__(self):
        st = dict(self.__dict__)
        st["_session"] = None
        return st

    def _sess(self):
        if self._session is None:
            self._session = _onnx_session(self.model_bytes)
        return self._session

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self._sess()
        inp = self.input_name or s.get_inputs()[0].name
        outs = [self.output_name] if self.output_name else None
        return np.asarray(s.run(outs, {inp: np.asarray(x, dtype=np.float32)})[0])


class OnnxFileModel(OnnxModel):
    """S11 for large artifacts: the model file is shipped once per executor with
    ``SparkContext.addFile`` and each Python worker opens its local copy."""

    def __init__(self, file_name: str, width: int, classes: int, **kw):
        super().__init__(b"", width, classes, _validate=False, **kw)
        self.file_name = file_name

    def _sess(self):
        if self._session is None:
            from pyspark import SparkFiles
            self._session = _onnx_session(SparkFiles.get(self.file_name))
        return self._session


def ship_model_file(spark, path: str, width: int | None = None, classes: int | None = None,
                    **kw) -> OnnxFileModel:
    """Validate the model on the driver (fail fast), register ``path`` with the
    cluster's file distribution, and return a model that loads it on the
    executors."""
    import os

    from framescore.session import read_bytes
    width, classes = _onnx_dims(_onnx_session(read_bytes(path)), width, classes)
    spark.sparkContext.addFile(path)
    return OnnxFileModel(os.path.basename(path), width, classes, **kw)


def byte_weights(width: int, classes: int) -> np.ndarray:
    """Deterministic integer weights ``((i * (k + 3)) % 17) - 8`` for image tests."""
    i = np.arange(width)[None, :]
    k = np.arange(classes)[:, None]
    return ((i * (k + 3)) % 17 - 8).astype(np.float64)


def fit_centroids(df: DataFrame, features: str = "embedding", label: str = "label",
                  name: str = "centroids") -> DenseSoftmax:
    """Dense stand-in model: one weight row per distinct label, the mean vector of its rows.

    Each task adds its feature vectors into one sum per label it meets and emits
    those; the sums of a label meet in a second Arrow pass that holds one vector at a
    time.  The driver receives k x d numbers, the model itself.  Rows without a label
    or with a null element carry nothing to learn; vectors of a label that differ in
    length are an error.
    """
    known = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()
                     & ~F.exists(features, lambda x: x.isNull()))
    rows = known.select(F.col(label).cast("bigint").alias("k"), F.col(features).cast("array<float>").alias("v"))
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.mapInArrow(_vector_sums, _SUMS).repartition(width, "k").mapInArrow(_merge_sums, _SUMS)
    got = sorted(sums.collect(), key=lambda r: r["k"])
    if not got:
        raise ValueError("no labelled rows to fit")
    if got[0]["k"] < 0:
        raise ValueError(f"class labels must be >= 0, found {got[0]['k']}")
    weights = np.stack([np.frombuffer(bytes(r["v"]), "<f8") / r["n"] for r in got])
    return DenseSoftmax(weights, name=name, labels=[r["k"] for r in got])


_SUMS = "k bigint, n bigint, v binary"


def _sum_rows(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()),
         pa.array([v.astype("<f8").tobytes() for _, v in held.values()], pa.binary())], names=["k", "n", "v"])


def _vector_sums(batches):
    held: dict = {}
    for batch in batches:
        labels = batch.column("k").to_numpy(zero_copy_only=False)
        column = batch.column("v")
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        begin = np.cumsum(lengths) - lengths
        for k in np.unique(labels):
            own = np.flatnonzero(labels == k)
            d = int(lengths[own[0]])
            if (lengths[own] != d).any():
                raise ValueError(f"feature vectors of label {k} differ in length")
            total = flat[begin[own][:, None] + np.arange(d)].sum(axis=0)
            n, v = held.get(int(k), (0, 0.0))
            held[int(k)] = (n + len(own), v + total)
    if held:
        yield _sum_rows(held)


def _merge_sums(batches):
    held: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            n, v = held.get(r["k"], (0, 0.0))
            held[r["k"]] = (n + r["n"], v + np.frombuffer(r["v"], "<f8"))
    if held:
        yield _sum_rows(held)


def ship_model(spark, model) -> str:
    """Ship a model of any size as a file to every executor; returns the file's name.

    The name is the content's hash, so a model is shipped once per application."""
    import atexit
    import hashlib
    import os
    import pickle
    import shutil
    import tempfile
    raw = pickle.dumps(model, protocol=pickle.HIGHEST_PROTOCOL)
    name = f"framescore-model-{hashlib.sha256(raw).hexdigest()[:24]}.pickle"
    sc = spark.sparkContext
    shipped = sc.__dict__.setdefault("_framescore_models", set())
    if name not in shipped:
        folder = tempfile.mkdtemp(prefix="framescore-model-")     # served until the driver ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, name)
        with open(path, "wb") as f:
            f.write(raw)
        sc.addFile(path)
        shipped.add(name)
    return name


_LOADED: dict = {}


def load_model(name: str):
    """The shipped model, opened once per Python worker (the latest one is kept)."""
    if name not in _LOADED:
        import pickle

        from pyspark import SparkFiles
        _LOADED.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = pickle.load(f)
    return _LOADED[name]
