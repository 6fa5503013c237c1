from framescore.streaming.runner import run_to_end, start_stream, trigger_args

__all__ = ["run_to_end", "start_stream", "trigger_args"]
