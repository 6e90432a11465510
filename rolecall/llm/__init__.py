"""Operators that prepare text for training: deduplication, filters, scoring, encoding."""
