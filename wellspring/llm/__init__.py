"""Operators for large text corpora: formatting, packing, privacy, quality, archives, deduplication."""
