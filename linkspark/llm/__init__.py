"""Operators for training-data pipelines: mixing, de-duplication, archives, filters, tokenising and media."""
