"""Operators for preparing training data: filters, mixing, deduplication, counting, packing and search."""
