"""Incremental ingest of chunk files by Structured Streaming."""
