"""Change files as a stream."""

from tidemark.streaming.changes import once_per_entry, run_merge_stream, stream_changes

__all__ = ["once_per_entry", "run_merge_stream", "stream_changes"]
