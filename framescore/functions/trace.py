"""Rendering of result lines and return-topic names.

Results are kept as typed columns and rendered to one STRING column ``value``
only at the sink.  ``concat`` (not ``concat_ws``) is used so a null field nulls
the line instead of silently shifting the fields; rejects are split off first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field order and separators of the three result layouts, and
# the suffix that names the result topic.
LAYOUTS = {
    # 7 fields, " : " separated (pass-through, no model)
    "passthrough": (" : ", ("send_time", "start_ms", "decode_ns", "end_ms",
                            "partition", "offset", "ans")),
    # 9 fields, " : " separated (model scoring)
    "scored": (" : ", ("send_time", "start_ms", "tensor_ns", "infer_ns", "post_ns",
                       "end_ms", "partition", "offset", "label")),
    # 4 fields, single space (key/value, first byte)
    "keyvalue": (" ", ("send_time", "start_ms", "end_ms", "first_byte")),
}
RETURN_SUFFIX = "-return"


def join_fields(cols, sep: str) -> Column:
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        c = F.col(c) if isinstance(c, str) else c
        parts.append(c.cast("string"))
    return F.concat(*parts)


def trace_line(layout: str) -> Column:
    """Render the named layout from same-named typed columns."""
    sep, fields = LAYOUTS[layout]
    return join_fields(fields, sep)


def return_topic(topic) -> Column:
    """Results go to ``<topic>-return``; accepts a topic name or a topic
    Column (so one query can serve many topics)."""
    t = F.lit(topic) if isinstance(topic, str) else topic
    return F.concat(t, F.lit(RETURN_SUFFIX))


def return_topic_name(topic: str) -> str:
    return topic + RETURN_SUFFIX
