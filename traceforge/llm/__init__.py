"""Operators of a training-data pipeline: deduplication, search, filters, extraction, packing."""
