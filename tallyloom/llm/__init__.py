"""Operators for large-scale training data and linkage; nothing outside imports this package."""
