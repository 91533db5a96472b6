"""Operators that a large training-data pipeline needs, each with a registered query."""
