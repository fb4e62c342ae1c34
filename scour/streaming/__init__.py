"""Incremental ingest with Structured Streaming."""

from .dedup import dedup_first, state_settings, waiting_rows
from .ingest import (POLL_SECONDS, dedup_ingest, dedup_stream, file_stream, ingest, next_increment,
                     poll_backlog, poll_once, poll_stream, poll_table)

__all__ = ["POLL_SECONDS", "dedup_first", "dedup_ingest", "dedup_stream", "file_stream", "ingest", "next_increment",
           "poll_backlog", "poll_once", "poll_stream", "poll_table", "state_settings", "waiting_rows"]
