"""Operators for preparing text corpora: counting, encoding, deduplication, scoring, packing, search."""
