"""Operators of a training-data pipeline: deduplication, filters, formatting and mixing of text corpora."""
