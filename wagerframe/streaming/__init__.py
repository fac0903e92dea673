"""Incremental scoring and running metrics on Structured Streaming."""
