"""Operators of a training-data pipeline: cleaning, deduplication, tokenizers, scoring."""
