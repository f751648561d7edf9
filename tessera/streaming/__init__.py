"""Structured Streaming forms of incremental ingestion."""
