"""Structured Streaming forms of ingest, refinement and feeds."""
