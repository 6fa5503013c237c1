"""Micro-benchmark of the decode + score kernel on one Arrow batch (no Spark).

    python tools/kernel_bench.py

Shape of the original keypoint workload: 10,000 payloads of 500 big-endian
float32 (2,000 bytes) into a 100-class dense softmax.  Random numbers stand in
for payload contents; this measures the per-core kernel, not a query.
"""
import os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import numpy as np, pyarrow as pa
from framescore.operators.scoring import _matrix_from_payload
from framescore.operators.models import DenseSoftmax
from framescore.functions.argmax import winning_class
rng = np.random.default_rng(0)
n, d, k = 10000, 500, 100
payload = rng.normal(size=(n, d)).astype('>f4')
arr = pa.array([row.tobytes() for row in payload], type=pa.binary())
w = rng.normal(size=(k, d))
for label, m in (("float64", DenseSoftmax(w)), ("float32", DenseSoftmax(w, dtype=np.float32))):
    for _ in range(2):                       # second pass is the warm one
        t0 = time.perf_counter()
        x, ok = _matrix_from_payload(arr, d, "f32be")
        t1 = time.perf_counter()
        s = m.predict(x)
        t2 = time.perf_counter()
        lab = winning_class(s)
        t3 = time.perf_counter()
    print(f"{label}: decode {1e3*(t1-t0):.1f} ms, predict {1e3*(t2-t1):.1f} ms, "
          f"argmax {1e3*(t3-t2):.1f} ms for {n} x {d} -> {k}; {n/(t3-t0):.0f} rows/s per core")
    assert np.array_equal(x, payload.astype(np.float32))

# LSTM on the same payloads: 500 floats as 20 steps x 25 features, hidden 64, 100 classes
from framescore.operators.models import LstmSoftmax  # noqa: E402
lstm = LstmSoftmax.seeded(steps=20, features=25, hidden=64, classes=k, seed=7)
for _ in range(2):
    t0 = time.perf_counter()
    x, ok = _matrix_from_payload(arr, d, "f32be")
    s = lstm.predict(x)
    lab = winning_class(s)
    t1 = time.perf_counter()
print(f"lstm float64 (20 x 25, hidden 64): {1e3*(t1-t0):.1f} ms per batch; "
      f"{n/(t1-t0):.0f} rows/s per core")
