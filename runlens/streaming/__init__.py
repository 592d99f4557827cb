"""Incremental ingest of the landing folder with Structured Streaming."""
