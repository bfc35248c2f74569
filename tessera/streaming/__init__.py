"""Structured Streaming forms of ingestion, deduplication and event analytics."""
