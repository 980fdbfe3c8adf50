"""Operators for building training data: filters, dedup, mixing, encoding, search."""
