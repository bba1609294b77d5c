"""Operators for training-data pipelines: searching, filtering, extracting, tokenizing, deduplicating."""
