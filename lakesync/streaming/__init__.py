"""Incremental file ingest (S3) and the streaming upsert sink."""

from lakesync.streaming.ingest import read_json_stream, run_upsert_stream, start_upsert_stream

__all__ = ["read_json_stream", "run_upsert_stream", "start_upsert_stream"]
