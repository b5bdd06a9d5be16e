"""Structured Streaming: ingest into a log, and replication from log to log."""
