"""Operators for training-data pipelines: search, quality, duplicates, packing, language models."""
