"""Incremental ingest of observation files with Structured Streaming."""

from sitewise.streaming.ingest import (  # noqa: F401
    read_observation_stream, start_clean_ingest, stream_daily_counts,
)
