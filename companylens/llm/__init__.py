"""Operators for training-data corpora: cleaning, deduplication, scoring, packing."""
