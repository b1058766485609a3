"""Structured Streaming ingest and counters."""
