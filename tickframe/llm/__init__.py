"""Operators and pipeline stages for training-data corpora."""
