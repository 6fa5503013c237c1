"""Malformed-record handling (the cases that crash the original jobs).

Every job declares what it can read as a ``RejectSpec``; ``tag_rejects`` adds
``reject_reason`` (null for good rows):
  null_key (only where the job reads the key), null_value,
  short_value (fewer bytes than one element),
  bad_width (element count differs from the model's width).
Bytes after the last whole element are *kept* and dropped by the decoder.  A key
that is not valid UTF-8 is kept (bad bytes become U+FFFD).  ``strict`` raises
instead, on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.functions.codec import FLOAT_BYTES

REASON = "reject_reason"
#: Every reason that ``reject_reason`` gives.
REASONS = ("null_key", "null_value", "short_value", "bad_width")


@dataclass(frozen=True)
class RejectSpec:
    """What a job needs of a record; ``width`` counts elements, null is any."""

    require_key: bool = True
    min_bytes: int = FLOAT_BYTES
    bytes_per_value: int = FLOAT_BYTES
    width: int | None = None

    def for_model(self, model) -> RejectSpec:
        width = getattr(model, "width", None)
        return self if width is None else replace(self, width=int(width))


FLOAT_RECORDS = RejectSpec()                                                   # keyed float payloads
BYTE_RECORDS = RejectSpec(min_bytes=1, bytes_per_value=1)                      # key and first byte
IMAGE_RECORDS = RejectSpec(require_key=False, min_bytes=1, bytes_per_value=1)  # value-only images


def reject_reason(spec: RejectSpec, key: str = "key", value: str = "value"):
    size = F.length(F.col(value))
    r = F.when(F.col(value).isNull(), F.lit("null_value"))
    if spec.require_key:
        r = F.when(F.col(key).isNull(), F.lit("null_key")).when(F.col(value).isNull(), F.lit("null_value"))
    r = r.when(size < spec.min_bytes, F.lit("short_value"))
    if spec.width is not None:
        r = r.when(F.floor(size / spec.bytes_per_value) != spec.width, F.lit("bad_width"))
    return r


def tag_rejects(df: DataFrame, key: str = "key", value: str = "value",
                width: int | None = None, require_key: bool = True,
                strict: bool = False, spec: RejectSpec | None = None) -> DataFrame:
    spec = spec or replace(FLOAT_RECORDS, width=width, require_key=require_key)
    r = reject_reason(spec, key, value)
    if strict:
        r = F.when(r.isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), r)))
    return df.withColumn(REASON, r)


def split_rejects(df: DataFrame, key: str = "key", value: str = "value",
                  width: int | None = None, require_key: bool = True,
                  spec: RejectSpec | None = None):
    """Return ``(good, rejects)``; both are lazy filters of one tagged plan."""
    t = tag_rejects(df, key, value, width, require_key, spec=spec)
    return t.where(F.col(REASON).isNull()).drop(REASON), t.where(F.col(REASON).isNotNull())
