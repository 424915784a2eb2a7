"""Operators for training-data text; nothing else in the library imports this package."""
