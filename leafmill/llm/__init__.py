"""Operators for text and training-data pipelines; nothing outside this folder imports it."""
