"""Operators of the training-data pipeline."""
