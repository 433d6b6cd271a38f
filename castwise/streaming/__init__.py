"""Structured Streaming forms of ingest, labelling, summaries and routing."""
