"""Operators of a training-data pipeline: deduplication, quality, language, packing, scans and search."""
