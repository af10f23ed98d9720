"""Structured Streaming forms of the ingest and status operators."""
