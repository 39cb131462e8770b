"""Operators for training-data pipelines: text, near copies, models, mixing, archives."""
