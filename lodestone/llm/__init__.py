"""Operators for preparing text corpora: mixing, deduplication, search, extraction, classification, packing."""
