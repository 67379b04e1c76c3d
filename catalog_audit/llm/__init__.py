"""Operators of a training-data pipeline: deduplication, filters, scoring, mixing, tokenization."""
