from framescore.functions.argmax import argmax_label, winning_class
from framescore.functions.codec import (be_float_at, clock_key, decode_features, decode_timed,
                                        encode_features, epoch_millis, first_byte_signed,
                                        first_feature, float_text, scale_bytes, scaled_sums,
                                        send_time, send_time_key)
from framescore.functions.trace import (LAYOUTS, join_fields, return_topic,
                                        return_topic_name, trace_line)

__all__ = [
    "argmax_label", "winning_class", "be_float_at", "clock_key", "decode_features",
    "decode_timed", "encode_features", "epoch_millis", "first_byte_signed", "first_feature",
    "float_text", "scale_bytes", "scaled_sums", "send_time", "send_time_key", "LAYOUTS",
    "join_fields", "return_topic", "return_topic_name", "trace_line",
]
