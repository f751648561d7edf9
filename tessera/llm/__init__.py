"""Operators of a training-data pipeline: filters, archives, search, deduplication, formatting, tokenization."""
