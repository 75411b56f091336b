"""Corpus operators for training data: filtering, deduplication, mixing, packing, search."""
