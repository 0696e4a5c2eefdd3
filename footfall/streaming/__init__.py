"""Structured Streaming forms of the ingest and trend jobs."""
