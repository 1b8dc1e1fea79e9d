"""Operators for large training-text pipelines. Nothing outside this package imports it."""
