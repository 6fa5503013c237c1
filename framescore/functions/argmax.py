"""Winning class of a score vector.

Rule: start from best = 0.0 at index 0 and move only on a strictly greater,
non-NaN score.  So ties go to the lowest index, and a vector that is empty,
all NaN or all <= 0 gives class 0.  Spark orders NaN above every number, which
is why ``array_position(a, array_max(a))`` is not the same rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_label(scores) -> Column:
    """Catalyst fold over an ARRAY<FLOAT|DOUBLE> column; returns INT."""
    s = F.col(scores) if isinstance(scores, str) else scores
    init = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    def step(acc, x):
        xd = x.cast("double")
        better = (xd > acc["m"]) & ~F.isnan(xd)
        return F.struct(F.when(better, xd).otherwise(acc["m"]).alias("m"),
                        F.when(better, acc["j"]).otherwise(acc["i"]).alias("i"),
                        (acc["j"] + 1).alias("j"))

    return F.aggregate(s, init, step, lambda acc: acc["i"])


def winning_class(scores: np.ndarray) -> np.ndarray:
    """The same rule on a [n, k] matrix, vectorised (used inside the scorer)."""
    scores = np.asarray(scores)
    if scores.ndim != 2 or scores.shape[1] == 0:
        return np.zeros(scores.shape[0] if scores.ndim else 0, dtype=np.int32)
    with np.errstate(invalid="ignore"):
        positive = np.where(scores > 0, scores, 0)
    return positive.argmax(axis=1).astype(np.int32)
