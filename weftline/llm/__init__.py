"""Operators for large text-training-data pipelines."""
