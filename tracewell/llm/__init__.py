"""Operators of a training-data pipeline: scoring, archives, deduplication, filters, mixing."""
