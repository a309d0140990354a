"""Operators for training-data pipelines over text, conversation and embedding tables."""
