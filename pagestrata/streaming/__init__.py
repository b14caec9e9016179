"""Structured Streaming forms of ingest and job status."""
