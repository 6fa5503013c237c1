from framescore.sources.csv import feature_csv, parse_features, render_csv_line
from framescore.sources.idx import idx_images, idx_labels, write_idx_pair
from framescore.sources.records import (RECORD_SCHEMA, from_offsets, kafka_options,
                                        publish_records, record_stream)

__all__ = [
    "feature_csv", "parse_features", "render_csv_line", "idx_images", "idx_labels",
    "write_idx_pair", "RECORD_SCHEMA", "from_offsets", "kafka_options",
    "publish_records", "record_stream",
]
