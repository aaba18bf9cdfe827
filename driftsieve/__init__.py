"""Incremental fuzzy deduplication of growing text corpora, on Spark."""

__version__ = "0.1.0"
