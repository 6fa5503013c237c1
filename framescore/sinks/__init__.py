from framescore.sinks.results import (kafka_sink_options, publish_kafka, read_results,
                                     read_return_topic, write_record_log, write_table,
                                     write_text)

__all__ = ["kafka_sink_options", "publish_kafka", "read_results", "read_return_topic",
           "write_record_log", "write_table", "write_text"]
