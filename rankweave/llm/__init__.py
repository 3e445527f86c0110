"""Operators for training-data pipelines, one module per operator; nothing else in the library imports them."""
