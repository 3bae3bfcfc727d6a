"""Corpus operators for training-data pipelines: cleaning, deduplication, mixing and output."""
